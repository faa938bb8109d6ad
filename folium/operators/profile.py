"""Completeness and null profiles of nested records, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import source_of
from ..functions.metrics import share

CATEGORIES = ("no_authors", "all_affiliations", "partial_affiliations", "no_affiliations")


def has_affiliation(institutions: Column) -> Column:
    return F.coalesce(F.size(institutions), F.lit(0)) > 0


def classify_works(works: DataFrame, source: str | None = None) -> DataFrame:
    """Works (of a source, by the last part of its id) with authors, affiliated, category and pct.

    works: id, doi, primary_location, authorships. Works with a source but without its id are
    match errors and left out; percentages are null without authors.
    """
    rows = works.where("_corrupt_record is null") if "_corrupt_record" in works.columns else works
    if source is not None:
        rows = rows.where(source_of(F.col("primary_location.source.id")) == source)
    n = F.coalesce(F.size("authorships"), F.lit(0))
    n = F.when(F.col("authorships").isNull(), 0).otherwise(n)
    hit = F.coalesce(F.size(F.filter("authorships", lambda a: F.coalesce(F.size(a.institutions) > 0, F.lit(False)))), F.lit(0))
    rows = rows.withColumns({"authors": n, "affiliated": F.when(F.col("authorships").isNull(), 0).otherwise(hit)})
    return rows.withColumns({"category": category(F.col("authors"), F.col("affiliated")), "pct": F.when(F.col("authors") > 0, F.col("affiliated") * 100.0 / F.col("authors"))})


def category(authors: Column, affiliated: Column) -> Column:
    return F.when(authors == 0, CATEGORIES[0]).when(affiliated == authors, CATEGORIES[1]).when(affiliated > 0, CATEGORIES[2]).otherwise(CATEGORIES[3])


def source_without_id() -> Column:
    """A work that names a source but not its id."""
    return F.col("primary_location.source").isNotNull() & F.col("primary_location.source.id").isNull()


def source_match_error(works: DataFrame) -> DataFrame:
    return works.where(source_without_id())


def completeness_summary(classified: DataFrame) -> DataFrame:
    """works_found, a count of each category among works with an id, shares of the full and partial, exact median pct."""
    known = F.col("id").isNotNull()
    counts = [F.count_if(known & (F.col("category") == c)).alias(c) for c in CATEGORIES]
    out = classified.agg(F.count("*").alias("works_found"), *counts, F.median(F.when(known, F.col("pct"))).alias("median_pct"))
    return out.withColumns({"all_pct": F.coalesce(share(F.col("all_affiliations"), F.col("works_found")), F.lit(0.0)), "partial_pct": F.coalesce(share(F.col("partial_affiliations"), F.col("works_found")), F.lit(0.0))})


def exact_median(df: DataFrame, column: str, bins: int = 1024, most: int = 100_000) -> float | None:
    """The exact median of a column's numbers (the mean of the two middle ones), without ordering them all.

    The range of values is cut into bins, which are counted; the bin that holds the middle is cut
    again, between the smallest and largest value that are in it, until it holds at most `most` rows
    or one value. Each round is a pass with `bins` counts; only the last bin's values, each with its
    number, come to one place. Nulls and NaN don't count; without numbers there is no median.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    found = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not found["n"]:
        return None

    def ranked(rank: int) -> float:
        n, lo, hi, below = found["n"], found["lo"], found["hi"], 0
        while lo < hi and n > most:
            # halves first, as the difference of two large numbers may have no double
            place = F.floor((F.col("x") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * bins)
            own = x.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy(F.least(place, F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            for r in sorted(own.collect(), key=lambda r: r["lo"]):
                if below + r["n"] > rank:
                    n, lo, hi = r["n"], r["lo"], r["hi"]
                    break
                below += r["n"]
        if lo == hi:
            return lo
        for r in x.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect():
            below += r["n"]
            if below > rank:
                return r["x"]
        raise RuntimeError("the table has changed between two passes")

    low, high = ranked((found["n"] - 1) // 2), ranked(found["n"] // 2)
    return low if low == high else low / 2 + high / 2


def null_status(authors: Column) -> Column:
    """no_authors, all_null, some_null or none_null of array<struct<affiliations array<struct<affiliation>>>>."""
    void = lambda a: F.coalesce(F.forall(a.affiliations, lambda x: F.coalesce(x.affiliation, F.lit("")) == ""), F.lit(True))
    return F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, "no_authors").when(F.forall(authors, void), "all_null").when(F.exists(authors, void), "some_null").otherwise("none_null")


def null_profile(works: DataFrame, column: str = "prediction") -> DataFrame:
    """(category, count, pct) of works, authors and affiliations, in report order."""
    a = F.coalesce(F.col(column), F.expr("array()"))
    entries = lambda x: F.coalesce(F.size(F.coalesce(x.affiliations, F.expr("array()"))), F.lit(0))
    good = lambda x: F.size(F.filter(F.coalesce(x.affiliations, F.expr("array()")), lambda f: F.coalesce(f.affiliation, F.lit("")) != ""))
    add = lambda f: F.aggregate(a, F.lit(0), lambda acc, x: acc + f(x))
    rows = works.select(null_status(F.col(column)).alias("s"), F.greatest(F.size(a), F.lit(0)).alias("n"), add(entries).alias("e"), add(good).alias("v"), add(lambda x: (good(x) > 0).cast("int")).alias("w"))
    t = rows.agg(*(F.count_if(F.col("s") == s).alias(s) for s in ("all_null", "some_null", "none_null", "no_authors")), F.count("*").alias("total"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "nevw"))
    pairs = [
        ("works_all_authors_missing_affiliations", "all_null", "total"), ("works_some_authors_missing_affiliations", "some_null", "total"), ("works_all_authors_have_affiliations", "none_null", "total"), ("works_no_authors", "no_authors", "total"), ("total_works", "total", "total"),
        ("total_authors", "n", None), ("authors_with_affiliations", "w", "n"), ("authors_without_affiliations", "n - w", "n"), ("total_affiliations", "e", None), ("valid_affiliations", "v", "e"),
    ]
    items = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(name).alias("category"), F.expr(c).cast("long").alias("count"), (share(F.expr(c), F.col(whole)) if whole else F.lit(None).cast("double")).alias("pct")) for i, (name, c, whole) in enumerate(pairs)))
    return t.select(F.inline(items)).orderBy("pos").drop("pos")


def share_table(df: DataFrame, column: str) -> DataFrame:
    """(value, count, pct) of a column's values."""
    from pyspark.sql import Window

    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    return counts.withColumn("pct", share(F.col("count"), F.sum("count").over(Window.partitionBy())))


def sample_rows(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows without replacement, the same ones for a seed and key; all if there are fewer."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary"))
    return df.orderBy(mark, *key).limit(n)


def sample_random(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order, each with how many more there are."""
    return df.orderBy(*order).limit(n).withColumn("remaining", F.lit(max(0, df.count() - n)).cast("long"))


def normalize_stats(df: DataFrame, column: str) -> DataFrame:
    """lookups, misses and hits of normalising each distinct value of a column once."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("lookups"), F.count("*").alias("misses"))
    return out.withColumn("hits", F.col("lookups") - F.col("misses"))


def missing_all(authors: Column) -> Column:
    """Whether no author has an affiliation; true without authors."""
    return F.coalesce(F.forall(authors, lambda a: F.coalesce(F.size(a.affiliations), F.lit(0)) <= 0), F.lit(True))


def run_summary(df: DataFrame, result: str, seconds: str, *by: str) -> DataFrame:
    """total, succeeded (result isn't null, even if empty), failed and mean seconds of inference rows, for each group if asked for."""
    ok = F.col(result).isNotNull()
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.avg(seconds).alias("avg_seconds"))
