"""Documents of an evaluation with their details, and tables of the right ones, the wrong ones and the errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import fixed
from .evaluation import METRICS, Evaluation, entity_details, with_scores

# The columns of the three tables.
CORRECT = ["doc_id", "status", "ground_truth_authors", "predicted_authors", "combined_strict_precision", "combined_strict_recall", "combined_strict_f1"]
ERRORS = [*CORRECT, "combined_strict_false_positives", "combined_strict_false_negatives", "entity_true_positives", "entity_false_positives", "entity_false_negatives", "notes"]
DETAILS = ["doc_id", "status", "match_level", "issue_type", "entity_name", "field_name", "ground_truth", "prediction", "detail"]

_SIDE = "struct<name:string,values:array<string>>"
_FIELDS = "array<struct<field:string,missed:array<string>,extra:array<string>,left_ground_truth:array<string>,left_prediction:array<string>,scalar:boolean>>"
#: Schema of document results, to read them back from JSON lines.
RESULTS = f"""doc_id string, status string, error string, entity string, key_field string,
  metrics array<struct<category:string,mode:string,{','.join(f'{m}:double' for m in METRICS[:5])},true_positives:bigint,false_positives:bigint,false_negatives:bigint>>,
  matches array<struct<match_type:string,ground_truth:{_SIDE},prediction:{_SIDE},similarity:double,fields:{_FIELDS}>>"""


def document_results(e: Evaluation) -> DataFrame:
    """A row per ground-truth document: status, error, metrics of every category and mode, and matches (see RESULTS).

    Matches are strict pairs, fuzzy pairs, and what the strict pass left over on either side, each
    in the order of the ground truth. The fields of a pair hold display text where values are
    compared strictly, normalised text for what fuzzy comparison leaves.
    """
    counts = with_scores(e.counts).select("doc_id", F.struct("category", "mode", *METRICS[:5], F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives")).alias("m"))
    metrics = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list("m")).alias("metrics"))
    empty = F.expr("cast(array() as array<string>)")
    scalar = lambda f, ok: F.struct(F.lit(f).alias("field"), F.when(ok, empty).otherwise(F.array(F.col(f"{f}_gt"))).alias("missed"), F.when(ok, empty).otherwise(F.array(F.col(f"{f}_pred"))).alias("extra"), empty.alias("left_ground_truth"), empty.alias("left_prediction"), F.lit(True).alias("scalar"))
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"{f}_missing_text").alias("missed"), F.col(f"{f}_extra_text").alias("extra"), F.col(f"{f}_left_gt").alias("left_ground_truth"), F.col(f"{f}_left_pred").alias("left_prediction"), F.lit(False).alias("scalar")) for f in e.config.array_fields]
    rows += [scalar(f, F.col(f"{f}_same")) for f in e.config.scalar_fields]
    fields = e.pairs.select("doc_id", "gt_idx", "pred_idx", (F.array(*rows) if rows else F.lit(None).cast(_FIELDS)).alias("fields"))
    side = lambda df, idx, out: df.select("doc_id", F.col("idx").alias(idx), F.struct(F.col("key").alias("name"), F.flatten(F.map_values("arrays")).alias("values")).cast(_SIDE).alias(out))
    d = entity_details(e).drop("ground_truth", "prediction").join(side(e.gt, "gt_idx", "ground_truth"), ["doc_id", "gt_idx"], "left").join(side(e.pred, "pred_idx", "prediction"), ["doc_id", "pred_idx"], "left")
    d = d.join(fields, ["doc_id", "gt_idx", "pred_idx"], "left")
    rank = F.element_at(F.create_map(*(F.lit(x) for k, v in enumerate(("strict", "fuzzy", "unmatched_ground_truth", "unmatched_prediction")) for x in (v, k))), F.col("kind"))
    match = F.struct(F.col("kind").alias("match_type"), "ground_truth", "prediction", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "fields")
    found = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "gt_idx", "pred_idx", match.alias("m")))).alias("l"))
    listed = e.config.schema.entities_field
    error = F.when(F.col("status") == "error", "Missing prediction").when(F.col("status") == "null_prediction", f"{listed} is None")
    out = e.documents.join(metrics, "doc_id", "left").join(found, "doc_id", "left")
    return out.select("doc_id", "status", error.alias("error"), F.lit(f"entity:{e.config.entity_slug}").alias("entity"), F.lit(e.config.key_field).alias("key_field"), "metrics", F.col("l.m").alias("matches"))


def _scores_of(category: Column) -> Column:
    """The strict scores of a category; null if there are none."""
    return F.try_element_at(F.filter("metrics", lambda m: (m.category == category) & (m.mode == "strict")), F.lit(1))


def is_perfect(results: DataFrame) -> Column:
    c = _scores_of(F.lit("combined"))
    return F.coalesce((F.col("status") == "success") & (c.false_positives == 0) & (c.false_negatives == 0), F.lit(False))


def _summary(results: DataFrame) -> DataFrame:
    show = fixed(3)
    c, n = _scores_of(F.lit("combined")), _scores_of(F.col("entity"))
    return results.withColumns({
        "ground_truth_authors": n.true_positives + n.false_negatives, "predicted_authors": n.true_positives + n.false_positives,
        "combined_strict_precision": show(c.precision), "combined_strict_recall": show(c.recall), "combined_strict_f1": show(c.f1_score),
        "combined_strict_false_positives": c.false_positives, "combined_strict_false_negatives": c.false_negatives,
        "entity_true_positives": n.true_positives, "entity_false_positives": n.false_positives, "entity_false_negatives": n.false_negatives,
    })


def correct_documents(results: DataFrame) -> DataFrame:
    """CORRECT of the documents without strict errors; results are those of document_results."""
    return _summary(results.where(is_perfect(results))).select(*CORRECT)


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def error_documents(results: DataFrame) -> DataFrame:
    """ERRORS of the other documents; notes name what is missing, what is too much and what differs in each field."""
    rows = _summary(results.where(~is_perfect(results)))
    named = lambda kind, side: F.filter(F.transform(F.filter("matches", lambda m: m.match_type == kind), lambda m: m[side]["name"]), lambda x: x.isNotNull() & (x != ""))
    said = lambda label, names, sep: F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, sep)))
    pairs = F.filter("matches", lambda m: m.match_type.isin("strict", "fuzzy"))
    issue = lambda m, f: F.concat(F.coalesce(_some(m.ground_truth["name"]), _some(m.prediction["name"]), F.lit("UNKNOWN")), F.lit(": "), F.concat_ws("; ", said("missed=", f.missed, " | "), said("extra=", f.extra, " | ")))
    wrong = F.flatten(F.transform(pairs, lambda m: F.transform(F.filter(m.fields, lambda f: ~f.scalar & ((F.size(f.missed) > 0) | (F.size(f.extra) > 0))), lambda f: F.struct(f.field.alias("field"), issue(m, f).alias("text")))))
    rows = rows.withColumn("_w", wrong)
    each = F.transform(F.array_distinct(F.col("_w.field")), lambda name: F.concat(name, F.lit("_issues="), F.array_join(F.transform(F.filter("_w", lambda x: x.field == name), lambda x: x.text), " || ")))
    notes = F.concat_ws(" ; ", said("missing_authors=", named("unmatched_ground_truth", "ground_truth"), " | "), said("extra_authors=", named("unmatched_prediction", "prediction"), " | "), F.when(F.col("status") != "success", F.concat(F.lit("error="), F.col("error"))), _some(F.array_join(each, " ; ")))
    return rows.withColumn("notes", notes).select(*ERRORS)


def error_details(results: DataFrame) -> DataFrame:
    """DETAILS: what went wrong in documents that aren't perfect, a row each.

    Beside errors of names and array fields, differing scalar fields have a row of their own.
    """
    bad = results.where(~is_perfect(results))
    text = lambda c: F.coalesce(c, F.lit(""))
    row = lambda level, issue, name, field, truth, said, detail: F.struct(F.lit(level).alias("match_level"), issue.alias("issue_type"), text(name).alias("entity_name"), field.alias("field_name"), text(truth).alias("ground_truth"), text(said).alias("prediction"), text(detail).alias("detail"))
    none, lit = F.lit(""), F.lit
    failed = bad.where("status <> 'success'").select("doc_id", "status", row("", lit("document_error"), none, none, none, none, F.col("error")).alias("d"))
    m = bad.where("status = 'success'").select("doc_id", "status", "key_field", F.explode("matches").alias("m"))
    truth, said = F.col("m.ground_truth"), F.col("m.prediction")
    name = F.coalesce(_some(truth["name"]), _some(said["name"]))
    joined = lambda c: F.array_join(c, " | ")
    alone = F.when(F.col("m.match_type") == "unmatched_ground_truth", row("strict", lit("missing_author"), name, F.col("key_field"), truth["name"], none, joined(truth["values"]))).when(F.col("m.match_type") == "unmatched_prediction", row("strict", lit("extra_author"), name, F.col("key_field"), none, said["name"], joined(said["values"])))
    near = F.when(F.col("m.match_type") == "fuzzy", row("fuzzy", lit("name_mismatch"), name, F.col("key_field"), truth["name"], said["name"], F.concat(lit("similarity="), F.col("m.similarity").cast("string"))))
    fields = m.where(F.col("m.match_type").isin("strict", "fuzzy")).select("doc_id", "status", name.alias("name"), F.explode("m.fields").alias("f"))
    issue = F.concat(F.col("f.field"), lit("_mismatch"))
    strict = F.when((F.size("f.missed") > 0) | (F.size("f.extra") > 0), row("strict", issue, F.col("name"), F.col("f.field"), joined(F.col("f.missed")), joined(F.col("f.extra")), none))
    fuzzy = F.when((F.size("f.left_ground_truth") > 0) | (F.size("f.left_prediction") > 0), row("fuzzy", issue, F.col("name"), F.col("f.field"), joined(F.col("f.left_ground_truth")), joined(F.col("f.left_prediction")), none))
    rows = failed.unionByName(m.select("doc_id", "status", F.explode(F.array_compact(F.array(alone, near))).alias("d"))).unionByName(fields.select("doc_id", "status", F.explode(F.array_compact(F.array(strict, fuzzy))).alias("d")))
    return rows.select("doc_id", "status", "d.*")
