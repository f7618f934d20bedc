"""Evaluation against a gold set: best match by token similarity, recall, agreement, composite fitness."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..fixed import DATA_SIGNALS, GOLD_POSITION, LABEL_POSITION, SOURCE_NAMES, SOURCE_SIGNALS, UNKNOWN_POSITION  # noqa: F401
from ..functions.joins import spread_join
from ..functions.similarity import Sides, Tokens, best_combined, best_shared
from ..functions.text import explanation_quality, jaccard, parsimony, source_citation, tokens
from ..sources.scratch import kept
from .rubric import lookup

#: Least similarity of a match; gold rows that one block of the combined match sends to every task.
THRESHOLD, GOLD_BLOCK = 0.20, 1_000
#: Rows of the smaller side up to which the match by shared tokens sends them to every task too; of larger sides it makes an index.
HELD = 4_000


def _streamed(gold: DataFrame, extracted: DataFrame, combined: bool, most: int | None = None) -> DataFrame | None:
    """ref_id, pos, similarity of candidates for the best match of gold rows (ref_id, claim, ta) with extracted texts (pos, text, tb).

    None if both sides have more than most rows.  The side with fewer rows goes to every task, in blocks of at most about GOLD_BLOCK rows, and the other streams by; a task
    keeps one candidate a row, so nothing is as large as the pairs are many.
    """
    spark = gold.sparkSession
    sides = gold.select(F.col("ref_id").alias("id"), F.col("ta").alias("tokens"), F.col("claim").alias("text")), extracted.select(F.col("pos").alias("id"), F.col("tb").alias("tokens"), "text")
    sides = sides if combined else tuple(s.drop("text") for s in sides)
    sizes = [s.count() for s in sides]
    if most is not None and min(sizes) > most:
        return None
    per_held = sizes[0] <= sizes[1]
    small, large = sides if per_held else sides[::-1]
    blocks = max(1, -(-min(sizes) // GOLD_BLOCK))
    kinds = [s.schema["id"].dataType.simpleString() for s in (small, large)]
    schema = f"held {kinds[0]}, other {kinds[1]}, similarity double"
    names, arrow = ["held", "other", "similarity"], to_arrow_schema(StructType.fromDDL(schema))
    out = []
    for block in range(blocks):
        rows = small.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # about GOLD_BLOCK rows
        sent = spark.sparkContext.broadcast([[r[c] for r in rows] for c in small.columns])

        def run(batches, sent=sent):
            for found in best_combined(Sides(*sent.value), batches, per_held) if combined else best_shared(Tokens(*sent.value), batches, per_held):
                yield pa.RecordBatch.from_pydict(dict(zip(names, found)), schema=arrow)

        out.append(large.mapInArrow(run, schema))
    both = reduce(DataFrame.unionAll, out)
    ref, pos = ("held", "other") if per_held else ("other", "held")
    return both.select(F.col(ref).alias("ref_id"), F.col(pos).alias("pos"), "similarity")


def _rarest_first(rows: DataFrame, key: str, uses: DataFrame) -> DataFrame:
    """key and its tokens that the index has, in order of their number of texts (df), each with it; and n, of all its tokens."""
    each = rows.select(key, F.size("tokens").alias("n"), F.explode_outer("tokens").alias("token"))
    ranked = spread_join(each, uses, ["token"], [key], how="left").groupBy(key).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))
    return ranked.select(key, "n", F.transform(F.filter("all", lambda x: x["df"].isNotNull()), lambda x: x["token"]).alias("rare"))


#: Tokens of a text that are looked up first.
PROBES = 4


def _jaccard(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """ref_id, pos, similarity of the best match of each gold row (ref_id, tokens) with extracted texts (pos, tokens) by shared tokens.

    Tokens are ordered from the rarest on.  A text's first few look up the texts that have them, which gives a
    similarity b to beat.  A pair at b or more has b / (1 + b) of both texts' tokens in common, so its first common token can't stand
    late in either text: the rest of the look-ups leave out a text's last, most common tokens, texts too long or too short,
    and places where too few tokens follow.  Common tokens so hardly ever bring texts together, and no row is lost.
    """
    gold, extracted = kept(gold, "gold"), kept(extracted, "extracted")  # tokens are made once
    uses = kept(extracted.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")), "uses")
    asked = kept(_rarest_first(gold, "ref_id", uses), "asked")
    held = _rarest_first(extracted, "pos", uses).select("pos", F.col("n").alias("nb"), F.col("rare").alias("tb"))
    index = kept(held.select("pos", "nb", "tb", F.posexplode("tb").alias("j", "token")), "index")
    far = uses.select("token", F.col("df").alias("n"))

    def found(probes: DataFrame, good: Column) -> DataFrame:
        both = F.size(F.array_intersect("ta", "tb"))
        pairs = spread_join(index, probes, ["token"], ["pos"], uses=far).where(good)
        best = pairs.select("ref_id", (both / (F.col("na") + F.col("nb") - both)).alias("similarity"), (-F.col("pos")).alias("pos")).groupBy("ref_id")
        return best.agg(F.max(F.struct("similarity", "pos")).alias("x")).select("ref_id", "x.similarity", (-F.col("x.pos")).alias("pos"))

    probe = asked.select("ref_id", F.col("n").alias("na"), F.col("rare").alias("ta"), F.posexplode("rare").alias("i", "token"))
    first = kept(found(probe.where(F.col("i") < PROBES), F.lit(True)), "first")
    rest = probe.where(F.col("i") >= PROBES).join(first.select("ref_id", F.col("similarity").alias("b")), "ref_id", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    follow, longest = F.size("ta") - F.col("i"), F.col("na") + F.col("nb")
    least = F.greatest(F.lit(1.0), F.col("b") / (1 + F.col("b")) * longest - 1e-6)
    good = (follow >= least) & (F.col("nb") - F.col("j") >= least) & (F.col("nb") >= F.col("b") * F.col("na") - 1e-6) & (F.col("b") * F.col("nb") <= F.col("na") + 1e-6)
    later = found(rest.where(F.size("ta") - F.col("i") >= F.col("b") * F.col("na") - 1e-6), good)
    best = first.unionByName(later).groupBy("ref_id").agg(F.max(F.struct("similarity", (-F.col("pos")).alias("pos"))).alias("x"))
    return best.select("ref_id", (-F.col("x.pos")).alias("pos"), "x.similarity")


def best_match(gold: DataFrame, extracted: DataFrame, combined: bool = False) -> DataFrame:
    """ref_id, matched_claim, similarity of each gold row (ref_id, claim): the extracted text (pos, text) most alike.

    Plain similarity is the share of common tokens.  If one side has at most HELD rows, every task counts what its rows share with these,
    and only a best row a task is shuffled; of two larger sides pairs are found by an index from the rarest tokens on.  The combined similarity also
    takes the token-set ratio, which sees parts of words, so every extracted text is held against the whole gold set;
    bounds leave few pairs to compare in full.  Of equal similarities the first text by pos counts.
    """
    g = gold.select("ref_id", F.col("claim"), tokens(F.col("claim")).alias("ta"))
    e = extracted.select("pos", "text", tokens(F.col("text")).alias("tb"))
    both = _streamed(g, e, combined, None if combined else HELD)
    if both is None:
        both = _jaccard(g.select("ref_id", F.col("ta").alias("tokens")), e.select("pos", F.col("tb").alias("tokens")))
    best = both.where("similarity > 0").groupBy("ref_id").agg(F.max(F.struct("similarity", (-F.col("pos")).alias("pos"))).alias("x"))
    # Written, so that its size is known: few best rows go to the texts, not all texts to them.
    named = extracted.select("pos", F.col("text").alias("matched_claim")).join(kept(best.select("ref_id", F.col("x.similarity").alias("similarity"), (-F.col("x.pos")).alias("pos")), "best"), "pos")
    return gold.select("ref_id").join(named, "ref_id", "left").select("ref_id", "matched_claim", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def agreement(gold_label: Column, label: Column) -> Column:
    """1 less the distance of two labels in the order of truth; the second may be of the verdicts' kind or of the gold set's."""
    gold = list(GOLD_POSITION.items())
    a = lookup(F.upper(F.trim(gold_label)), gold, UNKNOWN_POSITION)
    b = F.coalesce(lookup(F.trim(label), list(LABEL_POSITION.items())), lookup(F.upper(F.trim(label)), gold), F.lit(UNKNOWN_POSITION))
    return 1.0 - F.abs(a - b) / 5.0


def matches(gold: DataFrame, extracted: DataFrame, combined: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """best_match with the gold rows' own columns and whether the similarity is enough."""
    return gold.join(best_match(gold, extracted, combined), "ref_id").withColumn("matched", F.col("similarity") >= threshold)


def verdict_for(rows: DataFrame, verdicts: DataFrame, combined: bool = True, least: float = 0.1) -> DataFrame:
    """The verdict (pos, claim_text, label, explanation) most like each row's matched_claim, by ref_id; over least, or none."""
    asked = rows.where("matched_claim is not null").select("ref_id", F.col("matched_claim").alias("claim"))
    found = kept(best_match(asked, verdicts.select("pos", F.col("claim_text").alias("text")), combined).where(F.col("similarity") > least), "found")
    # Of verdicts with one text the first; only of texts that were found.
    told = verdicts.join(found.select(F.col("matched_claim").alias("claim_text")), "claim_text", "left_semi")
    first = told.groupBy("claim_text").agg(F.min(F.struct("pos", "label", "explanation")).alias("x")).select(F.col("claim_text").alias("matched_claim"), "x.label", "x.explanation")
    return found.select("ref_id", "matched_claim").join(first, "matched_claim").drop("matched_claim")


def run_fitness(gold: DataFrame, extracted: DataFrame, verdicts: DataFrame, tokens: int = 0, combined: bool = True) -> DataFrame:
    """One row on a run: recall, mean agreement, quality and citation, parsimony, fitness and counts, not rounded.

    gold: ref_id, claim, verdict; extracted: pos, text, is_checkable; verdicts: pos, claim_text, label, explanation.
    """
    # Both are read several times, and may be costly to make.
    asked, verdicts = kept(extracted.where(F.coalesce("is_checkable", F.lit(True))), "extracted"), kept(verdicts, "said")
    found = kept(matches(gold, asked, combined), "matches")  # three ways are read from it
    told = found.where("matched").join(verdict_for(found.where("matched"), verdicts, combined), "ref_id", "left")
    agree = F.when(F.col("label").isNotNull(), agreement(F.col("verdict"), F.col("label")))
    sums = found.agg(F.count_if("matched").alias("matched_count"), F.count(F.lit(1)).alias("references"))
    text = F.coalesce("explanation", F.lit(""))
    said = verdicts.agg(F.coalesce(F.avg(explanation_quality(text)), F.lit(0.0)).alias("explanation_quality"), F.coalesce(F.avg(source_citation(text)), F.lit(0.0)).alias("source_citation_quality"))
    one = sums.crossJoin(told.agg(F.coalesce(F.avg(agree), F.lit(0.0)).alias("verdict_agreement"))).crossJoin(said).crossJoin(asked.agg(F.count(F.lit(1)).alias("total_extracted")))  # one row each
    out = one.select((F.col("matched_count") / F.col("references")).alias("claim_recall"), "verdict_agreement", "explanation_quality", "source_citation_quality", parsimony(F.lit(tokens)).alias("parsimony"), "matched_count", "total_extracted")
    return out.withColumn("fitness", fitness(*map(F.col, ("claim_recall", "verdict_agreement", "explanation_quality", "source_citation_quality", "parsimony"))))


def rounded(run: DataFrame) -> DataFrame:
    """A run's row as reports show it: four places, and the fitness of the rounded parts."""
    parts = ["claim_recall", "verdict_agreement", "explanation_quality", "source_citation_quality", "parsimony"]
    return run.withColumns({c: F.round(c, 4) for c in parts}).withColumn("fitness", fitness(*map(F.col, parts)))


def extraction_fitness(recall: Column, brief: Column) -> Column:
    """Fitness of a run without verdicts."""
    return 0.25 * recall + 0.10 * brief


def approximate_fitness(recall: Column, agree: Column) -> Column:
    return 0.25 * recall + 0.30 * agree


def gold_evidence(explanation: Column, sources: Column) -> Column:
    """A gold row's own evidence: a note and its sources, a blank line between; a remark without either."""
    note = F.when(explanation != "", F.concat(F.lit("[Fact-checker note] "), explanation))
    named = F.when(F.size(sources) > 0, F.concat(F.lit("[Referenced sources: "), F.array_join(sources, ", "), F.lit("]")))
    both = F.concat_ws("\n\n", note, named)
    return F.when(both != "", both).otherwise("[No external evidence -- rely on training knowledge]")


def nearest_evidence(claims: DataFrame, gold: DataFrame, combined: bool = True, least: float = 0.1) -> DataFrame:
    """claim_id, evidence: the nearest gold row's sources, explanation and verdict, or that there is none.

    gold: ref_id, claim, verdict, explanation, sources; sources with a name in SOURCE_NAMES are given by it.
    """
    found = best_match(claims.select(F.col("claim_id").alias("ref_id"), F.col("text").alias("claim")), gold.select(F.col("ref_id").alias("pos"), F.col("claim").alias("text")), combined)
    first = gold.groupBy("claim").agg(F.min(F.struct("ref_id", "verdict", "explanation", "sources")).alias("x")).select(F.col("claim").alias("matched_claim"), "x.verdict", "x.explanation", "x.sources")
    names = F.array_join(F.transform("sources", lambda s: F.coalesce(lookup(s, SOURCE_NAMES), s)), "; ")
    told = F.concat(F.lit("[1] "), F.coalesce(F.nullif(names, F.lit("")), F.lit("Multiple sources")), F.lit("\n"), F.col("explanation"), F.lit("\n\n[Reference verdict from fact-checkers: "), F.col("verdict"), F.lit("]"))
    none = "[1] General fact-check sources\nNo specific evidence found for this claim."
    return found.where(F.col("similarity") >= least).join(first, "matched_claim").select(F.col("ref_id").alias("claim_id"), told.alias("evidence")).join(claims.select("claim_id"), "claim_id", "right").select("claim_id", F.coalesce("evidence", F.lit(none)).alias("evidence"))


#: Least similarity of a match in an evaluation of one model's answers.
EVAL_THRESHOLD = 0.15


def asked_of(found: DataFrame, gold: DataFrame) -> DataFrame:
    """What a model is asked for each matched gold row of matches: ref_id, claim_text, ref_verdict and evidence, the gold row's own by ref_id."""
    own = gold.select("ref_id", gold_evidence(F.coalesce("explanation", F.lit("")), F.coalesce("sources", F.array())).alias("evidence"))
    none = gold_evidence(F.lit(""), F.array())
    rows = found.where("matched").select("ref_id", F.coalesce("matched_claim", "claim").alias("claim_text"), F.col("verdict").alias("ref_verdict"))
    return rows.join(own, "ref_id", "left").withColumn("evidence", F.coalesce("evidence", none))


def eval_rows(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each question (ref_id, claim_text, ref_verdict), with its answer (ref_id, label, confidence, explanation) or what stands for none,
    agreement_score, mark and n, its place from the least agreement on, ties by ref_id."""
    asked = kept(asked, "asked")
    own = answers.select("ref_id", "label", "confidence", "explanation").join(asked.select("ref_id"), "ref_id", "left_semi")
    told = asked.join(own, "ref_id", "left")
    score = agreement(F.col("ref_verdict"), F.coalesce("label", F.lit("Unverifiable")))
    rows = told.select("ref_id", "claim_text", "ref_verdict", F.coalesce("label", F.lit("?")).alias("label"), F.coalesce("confidence", F.lit("?")).alias("confidence"), F.coalesce("explanation", F.lit("")).alias("explanation"), score.alias("agreement_score"))
    # A gold set's rows: a table that people wrote.
    return rows.withColumns({"mark": bucket(F.col("agreement_score")), "n": F.row_number().over(Window.orderBy("agreement_score", "ref_id"))})


def eval_totals(rows: DataFrame, gold: DataFrame, spent: DataFrame) -> DataFrame:
    """One row on eval_rows: matched, total_ref, recall, verdict_agreement, fitness_approx, and of spent (tokens_in, tokens_out) sums and cost."""
    one = rows.agg(F.count(F.lit(1)).alias("matched"), F.coalesce(F.avg("agreement_score"), F.lit(0.0)).alias("verdict_agreement"))
    used = spent.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")))
    out = one.crossJoin(gold.agg(F.count(F.lit(1)).alias("total_ref"))).crossJoin(used)  # one row each
    out = out.withColumn("recall", F.col("matched") / F.col("total_ref"))
    return out.withColumns({"fitness_approx": approximate_fitness(F.col("recall"), F.col("verdict_agreement")), "cost": cost(F.col("tokens_in"), F.col("tokens_out"))})


def eval_lines(rows: DataFrame) -> DataFrame:
    """n, line: eval_rows as a terminal's table."""
    return rows.select("n", F.format_string("  %-3s  %-22s  %-16s  %s", "mark", "ref_verdict", "label", F.substring("claim_text", 1, 55)).alias("line"))


def bucket(score: Column) -> Column:
    return F.when(score >= 0.8, "YES").when(score >= 0.4, "~").otherwise("NO")


def fitness(recall: Column, agree: Column, quality: Column, source: Column, brief: Column) -> Column:
    return 0.25 * recall + 0.30 * agree + 0.20 * quality + 0.15 * source + 0.10 * brief


def improvement(log: DataFrame) -> DataFrame:
    """One row of a log (gen, best): first and last best, what was gained, and that in percent (null unless first is positive)."""
    ends = log.agg(F.count(F.lit(1)).alias("generations"), F.min_by("best", "gen").alias("first_best"), F.max_by("best", "gen").alias("last_best"))
    gained = F.col("last_best") - F.col("first_best")
    return ends.select("*", gained.alias("gained"), F.when(F.col("first_best") > 0, gained / F.col("first_best") * 100).alias("percent"))


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars for tokens read and written."""
    return 15e-6 * tokens_in + 75e-6 * tokens_out
