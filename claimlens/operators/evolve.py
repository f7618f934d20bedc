"""Prompt evolution as iterated DataFrame steps; every draw is a hash of (seed, generation, island, slot, gene).

A population is some dozens of rows: slot, genes, generation, parents, mutations, and, once evaluated, scores.  Any number of
populations go side by side as islands, told apart by a column island; rows without that column are one population.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import CARRIED, EXTRACTION_GENES, GENE_NAMES, SEED_GENOMES, SYNTHESIS_GENES

GENES = [f"e_{g}" for g in EXTRACTION_GENES] + [f"s_{g}" for g in SYNTHESIS_GENES]
SIZES = dict(zip(GENES, [*EXTRACTION_GENES.values(), *SYNTHESIS_GENES.values()]))
#: Parts of a prompt in their order; the optional ones are left out at choice 0.
EXTRACTION_ORDER = ["persona", "methodology", "taxonomy", "filtering", "examples", "tone", "format"]
SYNTHESIS_ORDER = ["persona", "verdict_taxonomy", "evidence_weighting", "confidence", "reasoning", "nuance", "format"]
OPTIONAL = {"filtering", "examples", "tone", "evidence_weighting", "confidence", "reasoning", "nuance"}
#: Dollars a token, as far as that is known before a run, and bounds of a population.
TOKEN_COST, LEAST, MOST = 6e-6, 4, 12


@dataclass
class Config:
    generations: int = 5
    population: int = 8
    rate: float = 0.2
    tournament: int = 3
    elites: int = 2
    budget: float = 20.0
    seed: int = 0


def draw(seed: int, generation: int, *parts: Column) -> Column:
    """A number from 0 to 2**31 - 1 that depends on its arguments alone, so that lost tasks repeat it: the first 31 of 32 bits of an MD5."""
    told = F.concat_ws("|", F.lit(str(seed)), F.lit(str(generation)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("bigint") % (1 << 31)


def chance(seed: int, generation: int, *parts: Column) -> Column:
    return draw(seed, generation, *parts) / float(1 << 31)


def seeded(spark: SparkSession, size: int, seed: int = 0, given: list[list[int]] | None = None) -> DataFrame:
    """Slot 0 is the baseline of first choices, the next ones are given genomes (three that are known otherwise), the others are drawn."""
    fixed = [[0] * len(GENES), *(SEED_GENOMES if given is None else given)]
    slot = F.col("slot")

    def gene(i: int, g: str) -> Column:
        out = draw(seed, 0, slot, F.lit(g)) % SIZES[g]
        for at, genome in enumerate(fixed):
            out = F.when(slot == at, genome[i]).otherwise(out)
        return out.cast("int").alias(g)

    return spark.range(size).select(F.col("id").alias("slot"), *(gene(i, g) for i, g in enumerate(GENES)))


def individual_id(genes: list[str] = GENES) -> Column:
    """A short name of a genome: six places of either part's hash."""
    parts = [[g for g in genes if g.startswith(k)] for k in ("e_", "s_")]
    return F.concat(F.lit("e"), F.substring(genome_hash(parts[0]), 1, 6), F.lit("_s"), F.substring(genome_hash(parts[1]), 1, 6))


def _name(gene: str) -> str:
    return GENE_NAMES[gene[0]].format(gene[2:])


def breed(scored: DataFrame, generation: int, seed: int = 0, elites: int = 2, tournament: int = 3, rate: float = 0.2, lineage: bool = False) -> DataFrame:
    """The next generation of populations (island, slot, genes, fitness) of bounded size: elites, then crossed and mutated children.

    Children come as twins: for each gene one takes a parent's choice and the other the other parent's.  A parent is the
    fittest of `tournament` individuals drawn without replacement for the twins.  With lineage also generation, parents,
    mutations ("gene: old -> new"), evaluated and fitness: elites keep theirs, children have none yet.
    """
    alone = "island" not in scored.columns
    rows = scored.withColumn("island", F.lit(0)) if alone else scored
    rows = rows.select("island", "slot", *GENES, "fitness")
    large = rows.groupBy("island").count().where(F.col("count") > MOST * MOST).limit(1).collect()
    if large:
        raise ValueError(f"a population has {MOST * MOST} individuals at most, not {large[0]['count']}")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("island").orderBy(F.desc("fitness"), "slot")))
    kept = ranked.where(F.col("_r") <= elites).select("island", (F.col("_r") - 1).cast("long").alias("slot"), *GENES, F.lit(generation).alias("generation"), F.array(individual_id()).alias("parents"), F.array(F.lit(CARRIED)).alias("mutations"), F.lit(True).alias("evaluated"), F.col("fitness").cast("double").alias("fitness"))
    children = ranked.where(F.col("_r") > elites).select("island", (F.col("_r") - 1).cast("long").alias("child"))
    children = children.withColumns({"pair": F.floor((F.col("child") - elites) / 2), "twin": F.pmod(F.col("child") - elites, F.lit(2))})
    pool = children.select("island", "pair").distinct().join(rows, "island")  # a few dozen pairs and rows an island, as checked above

    def parent(side: str) -> DataFrame:
        order = Window.partitionBy("island", "pair").orderBy(draw(seed, generation, F.col("island"), F.col("pair"), F.col("slot"), F.lit(side)), "slot")
        drawn = pool.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= tournament)
        return drawn.groupBy("island", "pair").agg(F.max_by(F.struct(*GENES, individual_id().alias("id")), F.struct(F.col("fitness"), -F.col("slot"))).alias(side))

    def crossed(g: str) -> Column:
        first = chance(seed, generation, F.col("island"), F.col("pair"), F.lit(g), F.lit("cross")) < 0.5
        return F.when(first == (F.col("twin") == 0), F.col(f"a.{g}")).otherwise(F.col(f"b.{g}"))

    def shifted(g: str) -> Column:
        at = F.col("island"), F.col("child"), F.lit(g)
        return F.when(chance(seed, generation, *at, F.lit("mutate")) < rate, (F.col(f"_{g}") + 1 + draw(seed, generation, *at, F.lit("to")) % (SIZES[g] - 1)) % SIZES[g]).otherwise(F.col(f"_{g}")).cast("int")

    born = children.join(parent("a"), ["island", "pair"]).join(parent("b"), ["island", "pair"])
    born = born.select("island", F.col("child"), F.col("a.id").alias("_a"), F.col("b.id").alias("_b"), *(crossed(g).alias(f"_{g}") for g in GENES))
    born = born.select("*", *(shifted(g).alias(g) for g in GENES))
    log = F.filter(F.array(*(F.when(F.col(g) != F.col(f"_{g}"), F.format_string(f"{_name(g)}: %d -> %d", F.col(f"_{g}"), F.col(g))) for g in GENES)), lambda x: x.isNotNull())
    grown = born.select("island", F.col("child").alias("slot"), *GENES, F.lit(generation).alias("generation"), F.array("_a", "_b").alias("parents"), log.alias("mutations"), F.lit(False).alias("evaluated"), F.lit(None).cast("double").alias("fitness"))
    out = kept.unionByName(grown)
    out = out.drop("island") if alone else out
    return out if lineage else out.drop("generation", "parents", "mutations", "evaluated", "fitness")


def unevaluated(population: DataFrame) -> DataFrame:
    return population.where(~F.coalesce("evaluated", F.lit(False)))


def evaluate(population: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The population with all fitnesses; score gives slot (and island), fitness and tokens of those that have none yet."""
    keys = [c for c in ("island", "slot") if c in population.columns]
    done = score(unevaluated(population)).select(*keys, F.col("fitness").cast("double").alias("new"), F.col("tokens").cast("bigint").alias("tokens"))
    known = population.drop("tokens").join(done, keys, "left")
    return known.withColumns({"fitness": F.coalesce("new", "fitness"), "evaluated": F.lit(True), "tokens": F.coalesce("tokens", F.lit(0).cast("bigint"))}).drop("new")


def first_generation(genomes: DataFrame) -> DataFrame:
    """Genomes (slot and genes, and island if there are several populations) as a population that isn't evaluated yet."""
    none = F.array().cast("array<string>")
    return genomes.select(*(c for c in ("island", "slot") if c in genomes.columns), *GENES, F.lit(0).alias("generation"), none.alias("parents"), none.alias("mutations"), F.lit(False).alias("evaluated"), F.lit(None).cast("double").alias("fitness"))


def evolve(spark: SparkSession, score: Callable[[DataFrame], DataFrame], path: str, config: Config | None = None, genomes: DataFrame | None = None) -> DataFrame:
    """All generations as they were evaluated, from snapshots under path, one written a generation.

    They start from genomes, or from a population of config's size.  Before each generation the cost so far is held
    against the budget; the last one isn't bred from.  A snapshot cuts the lineage, so a lost executor costs at most one generation.
    """
    c = config or Config()
    size = min(max(c.population, LEAST), MOST)
    population = first_generation(seeded(spark, size, c.seed) if genomes is None else genomes)
    schema = ("island bigint, " if "island" in population.columns else "") + SNAPSHOT
    spent = 0.0
    for generation in range(c.generations):
        if spent >= c.budget:
            break
        at = f"{path}/generation={generation}"
        evaluate(population, score).drop("generation").write.mode("overwrite").json(at)
        kept = spark.read.schema(schema).json(at)
        spent += (kept.agg(F.sum("tokens").alias("n")).first()["n"] or 0) * TOKEN_COST
        population = breed(kept, generation + 1, c.seed, c.elites, c.tournament, c.rate, lineage=True)
    return spark.read.schema(f"{schema}, generation int").json(path)


def best_prompts(population: DataFrame, variants: dict[str, dict[str, list[str]]], n: int = 5) -> DataFrame:
    """One row: best, the fittest individual as JSON, its two prompts (extraction_prompt, synthesis_prompt), and top, the n fittest as JSON.

    variants: under "e" and "s" the texts of each gene.
    """
    told = F.struct(individual_id().alias("id"), *GENES, "fitness")
    rows = best(population, n).select("fitness", "slot", told.alias("x"), prompt("e", variants["e"]).alias("extraction"), prompt("s", variants["s"]).alias("synthesis"))
    order = F.struct((-F.col("fitness")).alias("at"), "slot", "x", "extraction", "synthesis")
    all_ = rows.agg(F.array_sort(F.collect_list(order)).alias("all"))  # n rows
    return all_.select(F.to_json(F.col("all")[0]["x"]).alias("best"), F.col("all")[0]["extraction"].alias("extraction_prompt"), F.col("all")[0]["synthesis"].alias("synthesis_prompt"), F.to_json(F.transform("all", lambda r: r["x"])).alias("top"))


SNAPSHOT = "slot bigint, " + ", ".join(f"{g} int" for g in GENES) + ", parents array<string>, mutations array<string>, evaluated boolean, fitness double, tokens bigint"


def log(snapshots: DataFrame) -> DataFrame:
    """generation, best, mean, size, cost so far, and best_ever, the best of this and all earlier ones."""
    each = snapshots.groupBy("generation").agg(F.max("fitness").alias("best"), F.avg("fitness").alias("mean"), F.count(F.lit(1)).alias("size"), F.sum("tokens").alias("tokens"))
    so_far = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)  # a row a generation
    return each.withColumns({"cost": F.sum("tokens").over(so_far) * TOKEN_COST, "best_ever": F.max("best").over(so_far)})


def within(told: DataFrame, budget: float) -> DataFrame:
    """The generations of a log that were begun: those before which the cost was under the budget."""
    before = F.lag("cost", 1, 0.0).over(Window.orderBy("generation"))
    return told.withColumn("_before", before).where(F.col("_before") < budget).drop("_before")


def best(population: DataFrame, n: int, by: str = "fitness", key: str = "slot") -> DataFrame:
    """The n fittest, ties by key."""
    return population.orderBy(F.desc(by), key).limit(n)


def elites(population: DataFrame, group: str, n: int, by: str = "fitness", key: str = "slot") -> DataFrame:
    """The n fittest of each group, ties by key."""
    order = Window.partitionBy(group).orderBy(F.desc(by), key)
    return population.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def plan(config: Config, claims: int = 29, synthesis: bool = True) -> dict[str, float]:
    """Calls and dollars of a run where no answer is kept: an extraction for each individual and a synthesis for each claim."""
    size = min(max(config.population, LEAST), MOST)
    calls = config.generations * size
    said = calls * claims if synthesis else 0
    return {"population": size, "extraction_calls": calls, "synthesis_calls": said, "cost": (calls * 4000 + said * 500) * TOKEN_COST / 2}


def prompt(part: str, variants: dict[str, list[str]]) -> Column:
    """The prompt of a genome's part, "e" or "s", from the variants of each of its genes."""
    order = EXTRACTION_ORDER if part == "e" else SYNTHESIS_ORDER
    texts = {g: F.element_at(F.array(*map(F.lit, variants[g])), F.col(f"{part}_{g}") + 1) for g in order}
    shown = [F.when(F.col(f"{part}_{g}") > 0, texts[g]) if g in OPTIONAL else texts[g] for g in order]
    if part == "s":  # the first two parts are one paragraph
        shown = [F.concat(shown[0], F.lit(" "), shown[1]), *shown[2:]]
    return F.concat_ws("\n\n", *shown)


def shown(genomes: DataFrame, variants: dict[str, dict[str, list[str]]]) -> DataFrame:
    """slot, id and both prompts of genomes, as they would be sent; seeded(spark, 1) is the baseline alone."""
    return genomes.select("slot", individual_id().alias("id"), prompt("e", variants["e"]).alias("extraction_prompt"), prompt("s", variants["s"]).alias("synthesis_prompt"))


def baseline(spark: SparkSession, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The baseline's row with its fitness, and nothing bred from it."""
    return evaluate(first_generation(seeded(spark, 1)), score)


def user_prompt(speaker: Column, date: Column, text: Column, head: str) -> Column:
    """What a transcript is sent with: its first 12,000 characters under a heading, speaker and date."""
    return F.concat(F.lit(f"{head}\nSpeaker: "), speaker, F.lit("\nDate: "), F.coalesce(date, F.lit("Unknown")), F.lit("\n\nTranscript:\n"), F.substring(text, 1, 12_000))


def to_json(genes: list[str] = GENES) -> Column:
    return F.to_json(F.struct(*genes))


def from_json(x: Column, genes: list[str] = GENES) -> list[Column]:
    """The genes of a genome's JSON; ones that it lacks are the first choice."""
    told = F.from_json(x, ", ".join(f"{g} int" for g in genes))
    return [F.coalesce(told[g], F.lit(0)).alias(g) for g in genes]


def genome_hash(names: list[str]) -> Column:
    return F.substring(F.sha2(F.concat_ws("-", *names), 256), 1, 16)


def memo_key(prompt: Column, content: Column) -> Column:
    """Under which an answer is kept: what was asked (16 places of its hash), and of what (12)."""
    return F.concat_ws("_", F.substring(F.sha2(prompt, 256), 1, 16), F.substring(F.sha2(content, 256), 1, 12))


def memoised(asked: DataFrame, memo: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers (key, answer) to all of asked (key, ...), and the memo with the new ones; only keys without one are answered, once each."""
    new = answer(asked.dropDuplicates(["key"]).join(memo.select("key"), "key", "left_anti")).select("key", "answer")
    held = memo.select("key", "answer").unionByName(new)
    return asked.select("key").join(held, "key"), held


def by_gene(population: DataFrame, *columns: str) -> DataFrame:
    """A row a gene of each individual: island, gene, choice and the columns that are asked for."""
    rows = F.explode(F.array(*(F.struct(F.lit(g).alias("gene"), F.col(g).alias("choice")) for g in GENES)))
    return population.select("island", *columns, rows.alias("x")).select("island", *columns, "x.*")


def importance(runs: DataFrame, genes: list[str]) -> DataFrame:
    """The best choice of each gene by mean fitness; ties: the one seen first (least seen)."""
    rows = F.explode(F.array(*(F.struct(F.lit(g).alias("gene"), F.col(g).alias("choice")) for g in genes)))
    means = runs.select("seen", "fitness", rows.alias("x")).select("seen", "fitness", "x.*").groupBy("gene", "choice").agg(F.avg("fitness").alias("mean"), F.min("seen").alias("first"), F.count(F.lit(1)).alias("n"))
    best = means.groupBy("gene").agg(F.max_by(F.struct("choice", "mean", "n"), F.struct(F.col("mean"), -F.col("first"))).alias("x"))
    return best.select("gene", F.col("x.choice").alias("best_choice"), F.col("x.mean").alias("best_mean"), F.col("x.n").alias("runs"))
