"""Model scoring as a pluggable provider, trait profiles and class typing.

A provider is any column of logits for (premise, hypothesis). The one here measures shared words; it
lets every downstream operator run and makes no claim to a model's quality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import probability as P
from loomgraph.functions import text as X
from loomgraph.runtime import checked_broadcast, cut, evaluated_once

TRAITS = ["openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism"]
POLES = ["positive", "negative", "neutral"]
WEIGHTS = ["high", "medium", "low"]
#: The (task, label, hypothesis) rows scored for every mention: five traits with three poles and one weight.
TASKS = [(t, p, {"positive": f"{{}} shows high {t}", "negative": f"{{}} shows low {t}", "neutral": f"nothing is said about the {t} of {{}}"}[p]) for t in TRAITS for p in POLES] + [
    ("ocean_weight", w, f"the passage has {w} value as evidence about {{}}") for w in WEIGHTS
]


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def _shared(have: Column, words: Column) -> Column:
    return 4.0 * F.size(F.array_intersect(words, have)) / F.greatest(F.size(words), F.lit(1)) - 2.0


def overlap_logit(premise: Column, hypothesis: Column) -> Column:
    """Stand-in entailment logit: the share of the hypothesis' words in the premise, spread over -2..2."""
    return _shared(_words(premise), _words(hypothesis))


def _prepared(mentions: DataFrame, logit) -> tuple[DataFrame, object]:
    """Mentions and a scorer of hypotheses; the stand-in splits each premise once instead of once per hypothesis."""
    if logit is not overlap_logit:
        return mentions, lambda hypothesis: logit(F.col("context_text"), hypothesis)
    return evaluated_once(mentions, "_w", _words(F.coalesce("context_text", F.lit("")))), lambda hypothesis: _shared(F.col("_w"), _words(hypothesis))


def task_table(spark) -> DataFrame:
    """The fixed label table (18 rows)."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TASKS)], "ordinal int, task string, label string, template string")


def score_tasks(mentions: DataFrame, logit=overlap_logit) -> DataFrame:
    """(mention_id, <task>_<label>_probability ...): the 18 probabilities of each mention, a softmax per task.

    ``mentions``: (mention_id, subject, context_text). The labels are literals of one projection, so a
    mention's 18 pairs are scored where the mention is, without a join or a shuffle.
    """
    name = F.coalesce("subject", F.lit("the character"))
    rows, score = _prepared(mentions, logit)
    shown = []
    for task in [*TRAITS, "ocean_weight"]:
        labels = [t for t in TASKS if t[0] == task]
        rows = evaluated_once(rows, f"_{task}", F.array(*(score(F.replace(F.lit(t[2]), F.lit("{}"), name)) for t in labels)))
        shown += [F.get(P.softmax_array(F.col(f"_{task}")), i).alias(f"{task}_{t[1]}_probability") for i, t in enumerate(labels)]
    return rows.select("mention_id", *shown)


def completed(evidence: DataFrame) -> DataFrame:
    """Rows whose 18 probabilities are all there."""
    cols = [f"{t}_{p}_probability" for t in TRAITS for p in POLES] + [f"ocean_weight_{w}_probability" for w in WEIGHTS]
    return evidence.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in cols)))


def latest(evidence: DataFrame, key: str = "mention_id", order: tuple[str, ...] = ("arrived_at", "chunk_index")) -> DataFrame:
    """The last delivery of each record, by one aggregation."""
    return evidence.groupBy(key).agg(F.max_by(F.struct(*[c for c in evidence.columns if c != key]), F.struct(*order)).alias("_r")).select(key, "_r.*")


def _rounding(digits: int | None, exact: bool):
    if digits is None:
        return lambda c: c
    return (lambda c: P.round_half_even(c, F.lit(digits))) if exact else (lambda c: F.round(c, digits))


def mention_scores(evidence: DataFrame, rounding: int | None = 2, exact: bool = False) -> DataFrame:
    """(keys, <trait>_score, <trait>_neutral, weight): bipolar scores and the evidence weight of completed rows.

    ``exact`` rounds as binary values stand, in Arrow batches; otherwise the native decimal rounding,
    which may differ by one in the last place. None leaves the scores as they are.
    """
    rnd = _rounding(rounding, exact)
    cols = []
    for t in TRAITS:
        p, n, u = (F.col(f"{t}_{x}_probability") for x in POLES)
        cols += [rnd(P.bipolar(p, n, u)).alias(f"{t}_score"), u.alias(f"{t}_neutral")]
    return completed(evidence).select("doc_id", "cluster_id", "mention_id", *cols, rnd(P.ocean_weight(F.col("ocean_weight_high_probability"), F.col("ocean_weight_medium_probability"))).alias("weight"))


def weighted_mean(score: Column, weight: Column, default: float = 50.0, least: float = 1e-9) -> Column:
    """Aggregate mean over positive weights; the default where they sum to (nearly) nothing."""
    w = F.when(weight > 0, weight)
    return F.when(F.sum(w) > least, F.sum(score * w) / F.sum(w)).otherwise(default)


def trait_profiles(evidence: DataFrame, rounding: int | None = 2, exact: bool = False) -> DataFrame:
    """(doc_id, cluster_id, five traits, n_mentions_scored): weighted means pushed away from the middle."""
    rnd = _rounding(rounding, exact)
    scores = mention_scores(evidence, rounding, exact)
    means = scores.groupBy("doc_id", "cluster_id").agg(*(weighted_mean(F.col(f"{t}_score"), F.col("weight") * (1 - F.col(f"{t}_neutral"))).alias(t) for t in TRAITS), F.count(F.lit(1)).alias("n_mentions_scored"))
    return means.select("doc_id", "cluster_id", *(rnd(P.skewed(F.col(t))).alias(t) for t in TRAITS), "n_mentions_scored")


def alignment_errors(evidence: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention_id, error) of evidence rows that disagree with the mention table on cluster, span or text."""
    m = mentions.select("doc_id", "mention_id", F.col("cluster_id").alias("c"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("text").alias("t"))
    rows = evidence.join(m, ["doc_id", "mention_id"], "left")
    rules = [("unknown_mention", F.col("c").isNull()), ("cluster", F.col("c") != F.col("cluster_id")), ("span", (F.col("s") != F.col("mention_start")) | (F.col("e") != F.col("mention_end"))), ("text", F.col("t") != F.col("mention_text"))]
    broken = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())
    return rows.select("doc_id", "mention_id", F.explode(broken).alias("error"))


# Typing: a greedy walk of each mention down the class graph, then one descent per cluster.

STAY = "(stay)"
#: Options a class graph may have in all.
MAX_OPTIONS = 100_000
ROOT = "(root)"


def class_options(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, ordinal, child, hypothesis): children in label order, roots under a virtual root, and a stay option."""
    children = edges.select(F.col("parent_iri").alias("parent"), F.col("child_iri").alias("child"))
    roots = classes.join(children.select(F.col("child").alias("iri")), "iri", "left_anti").select(F.lit(ROOT).alias("parent"), F.col("iri").alias("child"))
    label = classes.select(F.col("iri").alias("child"), F.col("human_readable_label").alias("label"))
    order = Window.partitionBy("parent").orderBy(F.lower("label"), "child")
    options = children.union(roots).join(label, "child").withColumn("ordinal", F.row_number().over(order)).select("parent", "ordinal", "child", F.concat(F.lit("{} is a "), F.lower("label")).alias("hypothesis"))
    stays = children.select("parent").distinct().join(label.withColumnRenamed("child", "parent"), "parent").select("parent", F.lit(1_000_000).alias("ordinal"), F.lit(STAY).alias("child"), F.concat(F.lit("{} is only a "), F.lower("label")).alias("hypothesis"))
    return options.union(stays)


def typing_walk(mentions: DataFrame, classes: DataFrame, edges: DataFrame, depth: int, logit=overlap_logit, allow_stay: bool = True) -> DataFrame:
    """(mention columns, path): each mention's walk as an array of (parent, child, edge_kind, edge_weight).

    Level by level for all mentions at once, at most ``depth`` levels: the class options are a small
    reference table packed into one row per parent and joined by the class a mention has reached; all
    children are scored inside that row. A single root is entered without a choice.
    """
    options = class_options(classes, edges)
    if not allow_stay:
        options = options.where(F.col("child") != STAY)
    packed = options.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("ordinal", "child", "hypothesis"))).alias("o")).select(F.col("parent").alias("at"), "o")
    name = F.coalesce("subject", F.lit("the character"))
    step = F.struct(F.lit("").alias("parent"), F.lit("").alias("child"), F.lit("").alias("edge_kind"), F.lit(0.0).alias("edge_weight"))
    rows, score = _prepared(mentions, logit)
    rows = rows.withColumn("at", F.lit(ROOT)).withColumn("path", F.slice(F.array(step), 1, 0))
    sent = checked_broadcast(packed, MAX_OPTIONS, "the class options")
    for _ in range(depth + 1):
        joined = rows.join(sent, "at", "left")
        joined = evaluated_once(joined, "_l", F.transform("o", lambda x: score(F.replace(x["hypothesis"], F.lit("{}"), name))))
        joined = evaluated_once(joined, "_p", P.softmax_array(F.col("_l")))
        ranked = F.zip_with("o", F.col("_p"), lambda x, v: F.struct(v.alias("v"), (-x["ordinal"]).alias("tie"), x["child"].alias("child")))
        joined = evaluated_once(joined, "_b", F.array_max(ranked)).drop("_l", "_p")
        alone = (F.col("at") == ROOT) & (F.size("o") == 1)
        kind = F.when(F.col("_b.child") == STAY, "stay").when(F.col("at") == ROOT, "root").otherwise("child")
        taken = F.struct(F.col("at").alias("parent"), F.col("_b.child").alias("child"), kind.alias("edge_kind"), F.col("_b.v").alias("edge_weight"))
        rows = joined.withColumn("path", F.when(F.col("_b").isNull() | alone, F.col("path")).otherwise(F.concat("path", F.array(taken)))).withColumn("at", F.when(F.col("_b").isNull() | (F.col("_b.child") == STAY), F.lit("(end)")).otherwise(F.col("_b.child"))).drop("o", "_b")
    return rows.drop("at", "_w")


def edge_scores(evidence: DataFrame, cluster: tuple[str, ...] = ("doc_id", "cluster_id"), rounding: int = 6) -> DataFrame:
    """(cluster, parent, child, score): the weighted edges of all mentions' paths; ``evidence`` has path and weight."""
    return evidence.select(*cluster, "weight", F.inline("path")).groupBy(*cluster, "parent", "child").agg(F.sum(F.col("weight") * F.col("edge_weight")).alias("score"))


def descend(scores: DataFrame, options: DataFrame, roots: DataFrame, depth: int, cluster: tuple[str, ...] = ("doc_id", "cluster_id")) -> DataFrame:
    """(cluster, class_iri, confidence): from the root to the best child, until staying is at least as good.

    ``options``: (parent, ordinal, child). One best child per cluster and class is chosen in a single
    aggregation; following them is a bounded number of small joins. A single root is the start,
    several hang under the virtual one.
    """
    named = scores.join(checked_broadcast(options.select("parent", "child", "ordinal"), MAX_OPTIONS, "the class options"), ["parent", "child"], "left")
    per = named.groupBy(*cluster, F.col("parent").alias("class_iri")).agg(
        F.max(F.when(F.col("child") != STAY, F.struct("score", (-F.coalesce("ordinal", F.lit(0))).alias("tie"), "child"))).alias("best"), F.coalesce(F.sum(F.when(F.col("child") == STAY, F.col("score"))), F.lit(0.0)).alias("stay"), F.sum("score").alias("total"),
    )
    per = cut(per, "best-child")
    single = roots.agg(F.count(F.lit(1)).alias("n"), F.min("iri").alias("iri"))
    rows = per.select(*cluster).distinct().crossJoin(F.broadcast(single)).select(*cluster, F.when(F.col("n") == 1, F.col("iri")).otherwise(ROOT).alias("class_iri"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("done"))
    for _ in range(depth + 1):
        j = rows.join(per, [*cluster, "class_iri"], "left")
        stop = F.col("done") | F.col("best").isNull() | ((F.col("stay") > 0) & (F.col("stay") >= F.col("best.score"))) | (F.col("best.score") <= 0)
        rows = j.select(*cluster, F.when(stop, F.col("class_iri")).otherwise(F.col("best.child")).alias("class_iri"), F.when(F.col("done") | F.col("best").isNull(), F.col("confidence")).when(stop, F.try_divide("stay", "total")).otherwise(F.try_divide("best.score", "total")).alias("confidence"), stop.alias("done"))
    return rows.drop("done")


# Typing evidence as records that can be checked and resumed

EVIDENCE_VERSION = 2
PATH = "array<struct<parent_class_iri:string,child_class_iri:string,edge_kind:string,edge_weight:double>>"


def typing_evidence(mentions: DataFrame, classes: DataFrame, edges: DataFrame, depth: int, weights: DataFrame | None = None, logit=overlap_logit, allow_stay: bool = True) -> DataFrame:
    """The mentions with schema_version, selected_path and mention_weight_raw: one evidence record each.

    A stay has no child, a start at one of several roots the virtual parent. ``weights``: (mention_id,
    high, medium, low) of the mention as evidence; where it is missing they are scored like a task.
    """
    walked = typing_walk(mentions, classes, edges, depth, logit, allow_stay)
    entry = lambda e: F.struct(e["parent"].alias("parent_class_iri"), F.when(e["child"] != STAY, e["child"]).alias("child_class_iri"), e["edge_kind"].alias("edge_kind"), e["edge_weight"].alias("edge_weight"))
    rows = walked.withColumn("selected_path", F.transform("path", entry)).drop("path")
    if weights is None:
        scored = score_tasks(mentions, logit)
        weights = scored.select("mention_id", *(F.col(f"ocean_weight_{w}_probability").alias(w) for w in WEIGHTS))
    raw = F.struct(*(F.col(w).alias(w) for w in WEIGHTS))
    return rows.join(weights.select("mention_id", raw.alias("mention_weight_raw")), "mention_id", "left").withColumn("schema_version", F.lit(EVIDENCE_VERSION))


def completed_typing(evidence: DataFrame) -> DataFrame:
    """(mention_id) of records that have both a path and a weight: what a resumed run need not score again."""
    return evidence.where("selected_path is not null and mention_weight_raw is not null").select("mention_id").distinct()


def path_errors(evidence: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, mention_id, edge_index, error) of path edges the class graph does not allow, or whose weight is no probability.

    A root edge leads from the virtual root to a root, a stay to no child, a child edge along the graph.
    """
    child = edges.select(F.col("child_iri").alias("iri")).distinct()
    known = classes.select("iri").distinct()
    steps = evidence.select("doc_id", "mention_id", F.posexplode("selected_path").alias("edge_index", "e")).select("doc_id", "mention_id", "edge_index", "e.*")
    flag = lambda df, column, name: df.select(F.col("iri").alias(column), F.lit(True).alias(name))
    allowed = edges.select(F.col("parent_iri").alias("parent_class_iri"), F.col("child_iri").alias("child_class_iri"), F.lit(True).alias("is_edge"))
    rows = steps.join(flag(known, "parent_class_iri", "known_parent"), "parent_class_iri", "left").join(flag(known, "child_class_iri", "known_child"), "child_class_iri", "left").join(flag(known.join(child, "iri", "left_anti"), "child_class_iri", "is_root"), "child_class_iri", "left").join(allowed, ["parent_class_iri", "child_class_iri"], "left")
    kind = F.col("edge_kind")
    error = (
        F.when(F.col("edge_weight").isNull() | F.isnan("edge_weight") | (F.col("edge_weight") < 0) | (F.col("edge_weight") > 1), "weight")
        .when(~F.coalesce(kind.isin("root", "stay", "child"), F.lit(False)), "kind")
        .when((kind == "root") & (F.col("parent_class_iri") != ROOT), "root_parent").when((kind == "root") & F.col("is_root").isNull(), "root_child")
        .when((kind == "stay") & F.col("child_class_iri").isNotNull(), "stay_child").when((kind != "root") & F.col("known_parent").isNull(), "unknown_parent")
        .when((kind == "child") & F.col("known_child").isNull(), "unknown_child").when((kind == "child") & F.col("is_edge").isNull(), "no_edge")
    )
    return rows.select("doc_id", "mention_id", "edge_index", error.alias("error")).where("error is not null")


def evidence_errors(evidence: DataFrame, mentions: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, mention_id, error): evidence of another version, without weight, off the class graph, or at odds with the mention table."""
    version = evidence.where(~F.coalesce(F.col("schema_version") == EVIDENCE_VERSION, F.lit(False))).select("doc_id", "mention_id", F.lit("version").alias("error"))
    weight = evidence.where("mention_weight_raw is null or mention_weight_raw.high is null or mention_weight_raw.medium is null").select("doc_id", "mention_id", F.lit("weight_missing").alias("error"))
    path = path_errors(evidence, classes, edges).select("doc_id", "mention_id", F.concat(F.lit("path_"), "error").alias("error"))
    return version.union(weight).union(path).union(alignment_errors(evidence, mentions)).distinct()


def trait_catalogue(spark) -> DataFrame:
    """(trait, pole, label): the traits' poles as readable labels; other catalogues may be passed to the scorer in its place."""
    return spark.createDataFrame([(t, p, template.replace("{}", "the character")) for t, p, template in TASKS], "trait string, pole string, label string")


def score_tasks_by_model(mentions: DataFrame, provider, batch: int = 64) -> DataFrame:
    """:func:`score_tasks` under a model provider: a mention's 18 pairs are scored in one call, then a softmax per task."""
    from loomgraph.operators.providers import entailment_logits

    name = F.coalesce("subject", F.lit("the character"))
    labels = [(t, p, template) for t, p, template in TASKS]
    asked = F.array(*(F.replace(F.lit(template), F.lit("{}"), name) for _, _, template in labels))
    rows = evaluated_once(mentions, "_l", entailment_logits(F.coalesce("context_text", F.lit("")), asked, provider, batch))
    shown = []
    for task in [*TRAITS, "ocean_weight"]:
        at = [i for i, t in enumerate(labels) if t[0] == task]
        rows = evaluated_once(rows, f"_{task}", P.softmax_array(F.slice("_l", at[0] + 1, len(at))))
        shown += [F.get(F.col(f"_{task}"), k).alias(f"{task}_{labels[i][1]}_probability") for k, i in enumerate(at)]
    return rows.select("mention_id", *shown)
