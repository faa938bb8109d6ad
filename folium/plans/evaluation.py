"""Evaluation of predicted entities against ground truth, and comparison of reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import slug
from ..functions.metrics import scores
from ..functions.similarity import assign_pairs, normalize, normalize_all, similarity
from ..operators.matching import compare_values, fuzzy_pairs, strict_pairs
from ..schema import EvalConfig
from ..shared import table

METRICS = ("precision", "recall", "f1_score", "f05_score", "f15_score", "true_positives", "false_positives", "false_negatives")


@dataclass
class Evaluation:
    """documents: doc_id, status. pairs: doc_id, gt_idx, pred_idx, kind, attributes. counts: doc_id, category, mode, tp, fp, fn."""

    documents: DataFrame
    gt: DataFrame
    pred: DataFrame
    pairs: DataFrame
    counts: DataFrame
    config: EvalConfig

    def report(self) -> DataFrame:
        """Micro totals of each category and reporting mode with all scores, in report order."""
        return report(self.counts.where(F.col("mode").isin(*self.config.reporting_modes)), self.config)

    def document_scores(self) -> DataFrame:
        return with_scores(self.counts)


def entities(docs: DataFrame, config: EvalConfig) -> DataFrame:
    """(doc_id, idx, key, arrays map<string,array<string>>, scalars map<string,string>) of (doc_id, entities variant).

    Entities that aren't objects or lack the key field go; a null key is the text None. Array values
    that aren't texts go.
    """
    key = config.key_field
    rows = docs.withColumn("_l", F.expr("try_variant_get(entities, '$', 'array<variant>')")).select("doc_id", F.posexplode("_l").alias("_i", "e"))
    rows = rows.where(F.expr(f"coalesce(array_contains(json_object_keys(to_json(e)), '{key}'), false)"))
    arrays = ", ".join(f"'{f}', filter(try_variant_get(e, '$.{f}', 'array<string>'), x -> x is not null)" for f in config.array_fields)
    scalars = ", ".join(f"'{f}', try_variant_get(e, '$.{f}', 'string')" for f in config.scalar_fields)
    rows = rows.withColumns({
        "key": F.expr(f"coalesce(try_variant_get(e, '$.{key}', 'string'), 'None')"),
        "arrays": F.expr(f"map({arrays})" if arrays else "cast(map() as map<string,array<string>>)"),
        "scalars": F.expr(f"map({scalars})" if scalars else "cast(map() as map<string,string>)"),
    })
    return rows.select("doc_id", F.col("_i").alias("idx"), "key", "arrays", "scalars")


def statuses(gt_docs: DataFrame, pred_docs: DataFrame) -> DataFrame:
    """(doc_id, status) of every ground-truth document: success, null_prediction, or error if there is no prediction."""
    pred = pred_docs.select("doc_id", F.lit(True).alias("_there"), F.col("entities").isNotNull().alias("_some"))
    j = gt_docs.select("doc_id").join(pred, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("_there").isNull(), "error").when(~F.col("_some"), "null_prediction").otherwise("success").alias("status"))


def evaluate(gt_docs: DataFrame, pred_docs: DataFrame, config: EvalConfig) -> Evaluation:
    """Matches (doc_id, entities variant) documents and counts.

    Every ground-truth document is there with a status: success, null_prediction or error (not
    predicted); only successes are counted. Predictions of other documents are left out. Entities,
    pairs and counts are written to the shared folder, so that each is normalised, matched and
    counted once, whatever is asked of the result.
    """
    status = statuses(gt_docs, pred_docs)
    good = status.where("status = 'success'").select("doc_id")
    gt = entities(gt_docs.join(good, "doc_id", "left_semi"), config)
    pred = entities(pred_docs.join(good, "doc_id", "left_semi"), config)
    rule = config.rule(config.key_field)
    normal = (lambda df: df.withColumn("norm", normalize("key"))) if rule.normalization else (lambda df: df.withColumn("norm", F.col("key")))
    gt, pred = table(normal(gt)), table(normal(pred))
    exact, gt_left, pred_left = strict_pairs(gt, pred, ["doc_id", "norm"])
    pairs = exact.select("doc_id", "gt_idx", "pred_idx", F.lit("strict").alias("kind"))
    if rule.fuzzy:
        near = fuzzy_pairs(gt_left, pred_left, "doc_id", "norm", rule.similarity_threshold, kind=rule.kind)
        pairs = pairs.unionByName(near.select("doc_id", "gt_idx", "pred_idx", F.lit("fuzzy").alias("kind")))
    pairs = table(attributes(pairs, gt, pred, config))
    return Evaluation(table(status), gt, pred, pairs, table(count_all(good, gt, pred, pairs, config)), config)


def attributes(pairs: DataFrame, gt: DataFrame, pred: DataFrame, config: EvalConfig) -> DataFrame:
    """Adds, for each array field f, what its values have in common and not, and full_strict and full_fuzzy.

    f_matched, f_missing and f_extra are normalised values; f_missing_text and f_extra_text are the
    last spellings of them; f_close are fuzzy pairs of what is missing and extra, f_left_gt and
    f_left_pred what those leave. A scalar field has f_gt, f_pred and f_same.
    """
    side = lambda df, p: df.select("doc_id", F.col("idx").alias(f"{p}_idx"), F.col("arrays").alias(f"{p}_arrays"), F.col("scalars").alias(f"{p}_scalars"))
    out = pairs.join(side(gt, "gt"), ["doc_id", "gt_idx"]).join(side(pred, "pred"), ["doc_id", "pred_idx"])
    strict, fuzzy = F.lit(True), F.lit(True)
    for f in config.array_fields:
        rule = config.rule(f)
        empty = F.expr("cast(array() as array<string>)")
        for p in ("gt", "pred"):
            value = F.coalesce(F.try_element_at(f"{p}_arrays", F.lit(f)), empty)
            out = out.withColumn(f"{f}_size_{p}", list_size(F.try_element_at(f"{p}_arrays", F.lit(f))))
            out = out.withColumn(f"_{p}_text", value).withColumn(f"_{p}", normalize_all(value) if rule.normalization else value)
        got = compare_values(F.col("_gt"), F.col("_pred"))
        out = out.withColumns({f"{f}_{k}": c for k, c in got.items()})
        close = assign_pairs(F.col(f"{f}_missing"), F.col(f"{f}_extra"), rule.similarity_threshold, rule.score) if rule.fuzzy else F.expr("cast(array() as array<struct<l:int,r:int,score:double>>)")
        out = out.withColumn(f"{f}_close", close)
        spelt = lambda p, kind, f=f: F.transform(f"{f}_{kind}", lambda n: F.element_at(F.filter(F.arrays_zip(F.col(f"_{p}").alias("n"), F.col(f"_{p}_text").alias("t")), lambda z: z.n == n), -1).t)
        rest = lambda kind, place, f=f: F.filter(f"{f}_{kind}", lambda n, i: ~F.exists(f"{f}_close", lambda c: c[place] == i))
        out = out.withColumns({f"{f}_missing_text": spelt("gt", "missing"), f"{f}_extra_text": spelt("pred", "extra"), f"{f}_left_gt": rest("missing", "l"), f"{f}_left_pred": rest("extra", "r")})
        left = [F.size(f"{f}_missing"), F.size(f"{f}_extra")]
        strict &= (left[0] == 0) & (left[1] == 0)
        fuzzy &= (left[0] == F.size(f"{f}_close")) & (left[1] == F.size(f"{f}_close"))
    for f in config.scalar_fields:
        for p in ("gt", "pred"):
            out = out.withColumn(f"{f}_{p}", F.coalesce(F.try_element_at(f"{p}_scalars", F.lit(f)), F.lit("")))
        a, b = F.col(f"{f}_gt"), F.col(f"{f}_pred")
        out = out.withColumn(f"{f}_same", a == b)
        strict &= F.col(f"{f}_same")
        fuzzy &= F.col(f"{f}_same") | (similarity(a, b, config.rule(f).score) >= config.rule(f).similarity_threshold) if config.rule(f).fuzzy else F.col(f"{f}_same")
    return out.withColumns({"full_strict": strict, "full_fuzzy": fuzzy}).drop("_gt", "_pred", "_gt_text", "_pred_text", "gt_arrays", "pred_arrays", "gt_scalars", "pred_scalars")


def list_size(c: Column) -> Column:
    """How many values a list has; a null one has none."""
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")


def count_all(docs: DataFrame, gt: DataFrame, pred: DataFrame, pairs: DataFrame, config: EvalConfig) -> DataFrame:
    """(doc_id, category, mode, tp, fp, fn): entities, array fields and the combination, in both modes.

    What documents, entities and pairs add to a document's counts is laid one below the other and
    summed by document at once, in tasks first, so no table is joined to another.
    """
    modes = {"strict": F.col("kind") == "strict", "fuzzy": F.lit(True)}
    one = lambda when: when.cast("long")
    lists = lambda df, p: df.select("doc_id", F.lit(1).cast("long").alias(f"n_{p}"), *(list_size(F.try_element_at("arrays", F.lit(f))).alias(f"{p}_{f}") for f in config.array_fields))
    own = []
    for mode, when in modes.items():
        own += [one(when).alias(f"pairs_{mode}"), one(when & F.col(f"full_{mode}")).alias(f"full_{mode}")]
        for f in config.array_fields:
            extra = F.size(f"{f}_close") if mode == "fuzzy" else F.lit(0)
            said = {"tp": F.size(f"{f}_matched") + extra, "fn": F.size(f"{f}_missing") - extra, "fp": F.size(f"{f}_extra") - extra}
            own += [F.when(when, c).cast("long").alias(f"{k}_{f}_{mode}") for k, c in said.items()]
            own += [F.when(when, F.col(f"{f}_size_{p}")).alias(f"{p}_{f}_{mode}") for p in ("gt", "pred")]
    t = docs.select("doc_id")
    for part in (lists(gt, "gt"), lists(pred, "pred"), pairs.select("doc_id", *own)):
        t = t.unionByName(part, allowMissingColumns=True)
    t = t.groupBy("doc_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in t.columns if c != "doc_id"))
    rows: list[Column] = []
    row = lambda c, m, tp, fp, fn: F.struct(F.lit(c).alias("category"), F.lit(m).alias("mode"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
    for mode in modes:
        n = F.col(f"pairs_{mode}")
        fn, fp = F.col("n_gt") - n, F.col("n_pred") - n
        rows.append(row(f"entity:{config.entity_slug}", mode, n, fp, fn))
        for f in config.array_fields:
            # of entities without a partner every value counts, repeated ones too
            alone = {p: F.col(f"{p}_{f}") - F.col(f"{p}_{f}_{mode}") for p in ("gt", "pred")}
            rows.append(row(f"field:{f}", mode, F.col(f"tp_{f}_{mode}"), F.col(f"fp_{f}_{mode}") + alone["pred"], F.col(f"fn_{f}_{mode}") + alone["gt"]))
        partial = (n - F.col(f"full_{mode}")) if config.harsh_penalty else F.lit(0)
        rows.append(row("combined", mode, F.col(f"full_{mode}"), fp + partial, fn + partial))
    return t.select("doc_id", F.inline(F.array(*rows)))


def with_scores(df: DataFrame) -> DataFrame:
    return df.withColumns(scores(F.col("tp"), F.col("fp"), F.col("fn")))


def category_rank(c: Column) -> Column:
    return F.when(c.startswith("entity:"), 0).when(c.startswith("field:"), 1).when(c == "combined", 2).otherwise(3)


def category_label(c: Column, entities_field: str = "authors") -> Column:
    tail = F.substring_index(c, ":", -1)
    return F.when(c.startswith("entity:"), F.concat(slug(tail), F.lit("_identification"))).when(c.startswith("field:"), F.concat(tail, F.lit("_matching"))).when(c == "combined", F.lit(f"combined_{entities_field}")).otherwise(c)


def report(counts: DataFrame, config: EvalConfig | None = None) -> DataFrame:
    """(mode, category, label, tp, fp, fn, scores): sums over documents, scores of the sums, in report order."""
    total = counts.groupBy("mode", "category").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    field = config.schema.entities_field if config else "authors"
    out = with_scores(total).withColumn("label", category_label(F.col("category"), field))
    return out.orderBy("mode", category_rank(F.col("category")), "category")


def entity_details(e: Evaluation) -> DataFrame:
    """Detail rows: strict and fuzzy pairs, then what the strict pass left over on both sides (so a fuzzy pair is there three times).

    similarity is 1 for equal normalised keys, else the threshold.
    """
    g = e.gt.select("doc_id", F.col("idx").alias("gt_idx"), F.col("key").alias("ground_truth"), F.col("norm").alias("_g"))
    p = e.pred.select("doc_id", F.col("idx").alias("pred_idx"), F.col("key").alias("prediction"), F.col("norm").alias("_p"))
    sim = F.when(F.col("_g") == F.col("_p"), 1.0).otherwise(e.config.rule(e.config.key_field).similarity_threshold)
    pairs = e.pairs.select("doc_id", "gt_idx", "pred_idx", "kind").join(g, ["doc_id", "gt_idx"]).join(p, ["doc_id", "pred_idx"]).withColumn("similarity", sim)
    exact = e.pairs.where("kind = 'strict'")
    none = F.lit(None)
    missed = g.join(exact, ["doc_id", "gt_idx"], "left_anti").select("doc_id", "gt_idx", none.cast("int").alias("pred_idx"), F.lit("unmatched_ground_truth").alias("kind"), "ground_truth", none.cast("string").alias("prediction"), none.cast("double").alias("similarity"))
    extra = p.join(exact, ["doc_id", "pred_idx"], "left_anti").select("doc_id", none.cast("int").alias("gt_idx"), "pred_idx", F.lit("unmatched_prediction").alias("kind"), none.cast("string").alias("ground_truth"), "prediction", none.cast("double").alias("similarity"))
    return pairs.select(*missed.columns).unionByName(missed).unionByName(extra)


def array_details(e: Evaluation) -> DataFrame:
    """A row per pair and array field with matched, missing and extra values and the close pairs."""
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"{f}_matched").alias("matched"), F.col(f"{f}_missing").alias("missing"), F.col(f"{f}_extra").alias("extra"), F.col(f"{f}_close").alias("close")) for f in e.config.array_fields]
    return e.pairs.select("doc_id", "gt_idx", "pred_idx", "kind", F.inline(F.array(*rows)))


def long_metrics(rep: DataFrame) -> DataFrame:
    """(mode, category, metric, value) of a report."""
    t = rep.withColumns({"true_positives": F.col("tp").cast("double"), "false_positives": F.col("fp").cast("double"), "false_negatives": F.col("fn").cast("double")})
    return t.unpivot(["mode", "category"], list(METRICS), "metric", "value")


def compare_reports(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(mode, category, metric, baseline, candidate, delta) of two long reports, where both have a value."""
    b = base.select("mode", "category", "metric", F.col("value").alias("baseline"))
    c = candidate.select("mode", "category", "metric", F.col("value").alias("candidate"))
    out = b.join(c, ["mode", "category", "metric"], "full").where("baseline is not null and candidate is not null")
    return out.withColumn("delta", F.col("candidate") - F.col("baseline"))
