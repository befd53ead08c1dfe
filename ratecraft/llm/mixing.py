"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source are laid out in a shuffled order of its documents and
cut into blocks of ``block_words`` words (the last may be shorter).  Slot i of
the schedule has the point ``i * g mod 1`` (g: the golden ratio's fraction, in
whole numbers of 2**-31); the point falls into one source's interval of the
cumulative slot shares, and the slot's rank among the source's slots says which
block it takes: rank r is block ``r mod blocks`` in epoch ``r div blocks``.
The schedule is cut, or closed by the few missing slots, so that each source
gives its quota exactly, with its last block cut to the word.

Targets: sources, in the order of their names with null last, weigh 3, 1, 2,
repeating, and share ``budget`` (150 %) of all words; a target stops at
``max_epochs`` (2) times its source's words, and the excess goes to the others
by weight until none is above.  That is a water level: sources sorted by cap /
weight are full up to the first whose share at the rest's level fits.

Only DataFrame operations.  Ranks and running sums over all rows are taken in
range slices or slot chunks, so that a source with a third of all rows is dealt
to many tasks.  Defined results: a null or empty text has 0 words and is taken
0 times; a null source is a source; of equal ids each row is taken on its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, running_totals, sheltered, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 512
POINTS = 1 << 31
GOLDEN = 1_327_217_885  # 2**31 times the golden ratio's fraction, made odd: every point comes once in 2**31 slots
CHUNK = 4096
BIN_BITS = 19  # 4096 bins of points


@dataclass
class Mix:
    """The tables of a mix.

    documents: ``row, doc_id, src, size, source_size, target, start`` (its first
    word's place in its source); sources: ``src, words, target, quota, blocks``
    and more; schedule: ``slot, src, rank, epoch, block, n_words`` (slots that
    close the schedule have numbers from its length on); placements: which
    words of which document row a slot takes.
    """

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame
    placements: DataFrame

    def taken(self) -> DataFrame:
        """``documents`` with ``taken``, the words the mix takes of each, and
        ``first_slot``, where the schedule first takes some (else null)."""
        counts = self.placements.groupBy("row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
        return self.documents.join(counts, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``src, words, first, weight, target`` per source of ``src, size, before_size``."""
    each = table(sizes.groupBy("src").agg(F.sum("size").alias("words"), F.min("before_size").alias("first"))
                 .withColumn("one", F.lit(1)), "sources")
    ranked = running_totals(each, ["src"], ["one"], "source-ranks")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights) + 1).cast("int")).cast("long")
    capped = (ranked.withColumn("weight", weight).withColumn("cap", F.col("words") * max_epochs)
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    filled = table(running_totals(capped, ["ratio", "src"], ["cap", "weight"], "source-levels"), "source-levels")
    words, weighed = filled.agg(F.sum("words"), F.sum("weight")).first()
    level = (F.lit(budget * (words or 0)) - F.col("before_cap")) / (F.lit(weighed or 0) - F.col("before_weight"))
    found = filled.withColumn("level", level).where(F.col("level") <= F.col("ratio")).agg(
        F.min_by("level", F.struct("ratio", "src"))).first()[0]
    # none fits only if the budget exceeds all caps together
    target = F.col("cap").cast("double") if found is None else F.least(F.col("cap").cast("double"), F.lit(found) * F.col("weight"))
    return filled.select("src", "words", "first", "weight", target.alias("target"))


def schedule_slots(sources: DataFrame) -> DataFrame:
    """``slot, src, rank`` for ``src, slots`` (the number each source needs)."""
    spark = sources.sparkSession
    placed = table(running_totals(sources.select("src", "slots"), ["src"], ["slots"], "slot-shares"), "slot-shares")
    n = placed.agg(F.sum("slots")).first()[0] or 0
    edge = lambda c: F.floor(c / F.lit(float(max(n, 1))) * POINTS)
    shares = (placed.withColumn("lo", edge(F.col("before_slots"))).withColumn("hi", edge(F.col("before_slots") + F.col("slots")))
              .where("hi > lo"))
    per_bin = shares.select("src", "lo", "hi", F.explode(F.sequence(
        F.shiftright("lo", BIN_BITS), F.shiftright(F.col("hi") - 1, BIN_BITS))).alias("bin"))
    points = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") % POINTS * GOLDEN % POINTS).alias("point"))
    drawn = points.withColumn("bin", F.shiftright("point", BIN_BITS)).join(per_bin, "bin").where("point >= lo and point < hi")
    drawn = table(drawn.select("slot", "src", F.floor(F.col("slot") / CHUNK).alias("chunk")), "drawn-slots")
    per_chunk = drawn.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select("src", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = (drawn.withColumn("own", F.row_number().over(own)).join(starts, ["src", "chunk"])
              .select("slot", "src", (F.col("earlier") + F.col("own") - 1).alias("rank")))
    met = drawn.groupBy("src").agg(F.count(F.lit(1)).alias("drawn"))
    closing = (sources.select("src", "slots").join(met, "src", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
               .where("drawn < slots").select("src", "drawn", F.explode(F.sequence("drawn", F.col("slots") - 1)).alias("rank"))
               .select((F.lit(n) + F.col("rank") - F.col("drawn")).alias("slot"), "src", "rank"))
    return ranked.unionByName(closing)


def mix(docs: DataFrame, *, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
        block_words: int = BLOCK_WORDS, seed: str = "mix", row: str | None = None) -> Mix:
    """Plan a mix of ``docs`` (``doc_id, source, text``).  ``row`` may name a
    column that identifies rows; else they are numbered."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
                                     .cast("binary")), 1, 15), 16, 10).cast("long")
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))  # "=" sorts before "n": null is last
    sized = table(docs.select(number.alias("row"), "doc_id", name.alias("src"), word_count(F.col("text")).alias("size"),
                              place.alias("place")), "document-sizes")
    laid = table(running_totals(sized, ["src", "place", "row"], ["size"], "document-places"), "document-places")
    sources = targets(laid, weights, budget, max_epochs)
    quota = F.round("target").cast("long")
    blocks = F.ceil(F.col("words") / block_words)
    slots = F.when(quota > 0, F.floor(F.col("quota") / F.col("words")) * F.col("blocks")
                   + F.ceil(F.col("quota") % F.col("words") / block_words)).otherwise(0)
    sources = table(sources.withColumn("quota", quota).withColumn("blocks", blocks).withColumn("slots", slots), "source-quotas")

    block, epoch = F.col("rank") % F.col("blocks"), F.floor(F.col("rank") / F.col("blocks"))
    of = sources.select("src", "words", "quota", "blocks", "slots")
    schedule = (schedule_slots(sources).join(of, "src").where("rank < slots")
                .withColumn("block", block).withColumn("epoch", epoch)
                .withColumn("n_words", F.least(F.lit(block_words).cast("long"), F.col("words") - F.col("block") * block_words,
                                               F.col("quota") - F.col("epoch") * F.col("words") - F.col("block") * block_words))
                .select("slot", "src", "rank", "epoch", "block", "n_words"))

    documents = laid.join(sources.select("src", "first", F.col("words").alias("source_size"), "target"), "src").select(
        "row", "doc_id", "src", "size", "source_size", "target", (F.col("before_size") - F.col("first")).alias("start"))
    pieces = documents.where("size > 0").select("row", "src", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("n_words"))
    placements = (pieces.join(schedule, ["src", "block"]).select(
        "slot", "src", "epoch", "block", "row", (begin - F.col("start")).alias("first_word"), (end - begin).alias("n_words"))
        .where("n_words > 0"))
    return Mix(documents, sources, schedule, placements)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that a mix takes, with the columns of ``docs``: a document that
    is taken twice comes twice, and the one of each source that the quota cuts
    comes with its first words only (``n_chars``, where there, is counted anew).
    """
    rows, back = sheltered(docs, "doc_id", "source", "text", "n_chars")
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    taken = mix(rows, row="row", **options).taken().where("taken > 0").select("row", "size", "taken")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    each = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    copies = rows.join(taken.select("row", F.explode(each).alias("cut")), "row")
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    text = F.when(F.col("cut") > 0, F.array_join(F.slice(words, 1, F.greatest("cut", F.lit(1))), "")).otherwise(F.col("text"))
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("cut") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(out)


ORACLE = """
with sized as (
  select doc_id, coalesce('=' || source, 'null') src,
         cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size,
         cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) place
  from documents),
each as (select src, cast(sum(size) as bigint) words from sized group by src),
ranked as (select *, words * 2 cap, [3, 1, 2][cast((row_number() over (order by src) - 1) % 3 as int) + 1] weight from each),
levels as (
  select *, cap / weight ratio,
         (1.5e0 * sum(words) over () - coalesce(sum(cap) over before, 0))
         / (sum(weight) over () - coalesce(sum(weight) over before, 0)) lvl
  from ranked
  window before as (order by cap / weight, src rows between unbounded preceding and 1 preceding)),
water as (select arg_min(lvl, (ratio, src)) lvl from levels where lvl <= ratio),
sources as (
  select src, words, least(cast(cap as double), (select lvl from water) * weight) target,
         cast(round(least(cast(cap as double), (select lvl from water) * weight)) as bigint) quota
  from levels),
laid as (
  select *, coalesce(sum(size) over (partition by src order by place, doc_id
                                     rows between unbounded preceding and 1 preceding), 0)::bigint first_word
  from sized),
needs as (
  select src, words, quota, cast(ceil(words / 512) as bigint) blocks,
         case when quota > 0 then cast(quota // words * ceil(words / 512) + ceil(quota % words / 512) as bigint) else 0 end slots
  from sources),
placed as (
  select *, coalesce(sum(slots) over (order by src rows between unbounded preceding and 1 preceding), 0) before_slots,
         sum(slots) over () n
  from needs),
points as (
  select i slot, i % 2147483648 * 1327217885 % 2147483648 point
  from (select unnest(range(cast(coalesce(sum(slots), 0) as bigint))) i from needs)),
drawn as (
  select slot, src, row_number() over (partition by src order by slot) - 1 rank
  from points join placed on point >= floor(before_slots / cast(n as double) * 2147483648)
                         and point < floor((before_slots + slots) / cast(n as double) * 2147483648)),
met as (select p.src, n, slots, coalesce(d.n_drawn, 0) n_drawn
        from placed p left join (select src, count(*) n_drawn from drawn group by src) d using (src)),
closing as (
  select cast(n as bigint) + rank - n_drawn slot, src, rank
  from (select src, n, n_drawn, unnest(range(n_drawn, slots)) rank from met where n_drawn < slots)),
schedule as (
  select slot, src, rank % blocks block,
         least(512, words - rank % blocks * 512, quota - rank // blocks * words - rank % blocks * 512) n_words
  from (select * from drawn union all select * from closing) join needs using (src) where rank < slots),
pieces as (
  select doc_id, src, size, first_word, unnest(range(first_word // 512, (first_word + size - 1) // 512 + 1)) block
  from laid where size > 0),
starts as (
  select doc_id, src, first_word, min(slot) first_slot from pieces join schedule using (src, block)
  where least(first_word + size, block * 512 + n_words) > greatest(first_word, block * 512)
  group by doc_id, src, first_word)
select doc_id, size, words source_size, target,
       cast(greatest(0, least(size, quota - first_word)) + greatest(0, least(size, quota - words - first_word)) as bigint) taken,
       case when size > 0 then first_slot end first_slot
from laid join sources using (src) left join starts using (doc_id, src, first_word)
"""
