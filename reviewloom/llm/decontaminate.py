"""Benchmark decontamination by template canonicalisation.

Texts become templates: words in lower case, with numbers, names and units replaced by typed placeholders. A
number is one placeholder however it is written (3.5, 1,000, twenty-five), a unit may be attached to it (5kg),
and a run of placeholders of one type is one.

All windows of ``PIECE`` template words of the documents meet those of the benchmark in a hash join. Windows on
one diagonal (same distance between the two places) or on diagonals at most ``SHIFT`` apart belong to one
occurrence, so words may be changed, added or dropped, names outside the list among them. It counts if its
windows cover ``SHARE`` of the item's words or ``QUOTED`` words, ``WINDOW`` in any case, and if its slots are
consistent: every value of the item stands for one value of the document. So a question with other numbers,
names or units is caught, and one whose numbers are mixed up is not. ``coverage`` is the share of the item's
words; ``exact`` says that all slots have the item's own values.

The benchmark's windows are broadcast after counting them (at most 2^20), else joined by shuffle. Only
windows that match leave the row of their document, and frequent passages are combined where they are found.

Defined results: null and empty texts match nothing; an item of fewer than ``LEAST`` template words identifies
nothing and is never matched; one of fewer than ``WINDOW`` words is one window of its own length and matches whole. Repeated
rows are judged alike and give their (id, item) once; ids of either may be null. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.arrays import unfold
from reviewloom.llm.common import documents, small_enough, text_or_empty
from reviewloom.session import cut_lineage

WINDOW = 8
LEAST = 5
COVERAGE = 0.8  # of the item's windows on one diagonal: the SQL's rule
PIECE = 4
SHIFT = 8
SHARE = 0.5
QUOTED = 24
# Words that stand for numbers, units and given names.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = (
    "mm cm m km mg g kg ml l kb mb gb tb hz khz mhz ghz mph kmh kw kwh "
    "second seconds minute minutes hour hours day days week weeks month months year years inch inches foot feet yard yards mile miles "
    "meter meters metre metres kilometer kilometers centimeter centimeters gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres gallon gallons dollar dollars euro euros cent cents percent degree degrees"
).split()
NAMES = (
    "alice bob carol david emma frank grace henry ivan jack james jane john julia karen kevin laura linda maria mark mary michael "
    "nancy oliver patricia paul peter rachel robert sam sarah sophia susan thomas tom william anna ben charlie daniel elena george "
    "hannah isabel jason kate leo lucy max mia natalia noah olivia pedro rosa simon tina victor wendy zoe"
).split()

_WORDS_OF_NUMBERS = "|".join(NUMBER_WORDS)
# The forms of one word of a slot, and its placeholder.
SLOTS = [
    (rf"\p{{N}}[\p{{N}}_]*|(?:{_WORDS_OF_NUMBERS})(?:_(?:{_WORDS_OF_NUMBERS}))*", "<num>"),
    ("|".join(UNITS), "<unit>"),
    ("|".join(NAMES), "<name>"),
]


def marked(text: Column) -> Column:
    """The words in lower case, joined by blanks. A run of slot words of one type is one word, joined by "_"."""
    lined = F.translate(F.lower(text), "_", " ")
    lined = F.regexp_replace(lined, r"(?<=\p{N}),(?=\p{N}{3}(?!\p{N}))", "")
    lined = F.regexp_replace(lined, r"(?<=\p{N})[.,](?=\p{N})", "_")
    lined = F.trim(F.regexp_replace(lined, r"[^\p{L}\p{N}_]+", " "))
    lined = F.regexp_replace(lined, r"(?<![^ ])(\p{N}[\p{N}_]*)(?=\p{L})", "$1 ")
    lined = F.regexp_replace(lined, rf"(?<![^ ])(hundred|thousand|million) and (?=(?:{_WORDS_OF_NUMBERS})(?![^ ]))", "$1_")
    for one, _ in SLOTS:
        lined = F.regexp_replace(lined, rf"(?<![^ ])({one}) (?=(?:{one})(?![^ ]))", "$1_")
    return lined


def words(text: Column) -> Column:
    """The words of a text, as many as ``template`` has."""
    return F.split(marked(text), " ")


def template(text: Column) -> Column:
    """The template's words, one per word of ``words``.

    Numbers are replaced first, as they stand in the text; all other slot words are looked up word by word in
    fixed sets. Every pattern begins with a character that few places have.
    """
    lined = F.translate(F.lower(text), "_", " ")
    lined = F.regexp_replace(lined, r",(?=\p{N}{3}(?!\p{N}))(?<=\p{N},)", "")
    lined = F.regexp_replace(lined, r"[.,](?=\p{N})(?<=\p{N}[.,])", "_")
    lined = F.trim(F.regexp_replace(lined, r"[^\p{L}\p{N}_]+", " "))
    lined = F.rtrim(F.regexp_replace(lined, r"\p{N}(?<![^ ]\p{N})[\p{N}_]* ?", "<num> "))
    lined = F.regexp_replace(lined, rf" and (?=(?:{_WORDS_OF_NUMBERS})(?![^ ]))(?<=(?<![^ ])(?:hundred|thousand|million) and )", " ")

    def typed(word):
        return F.when(word.isin(NUMBER_WORDS), "<num>").when(word.isin(UNITS), "<unit>").when(word.isin(NAMES), "<name>").otherwise(word)

    lined = F.array_join(F.transform(F.split(lined, " "), typed), " ")
    for _, slot in SLOTS:
        lined = F.regexp_replace(lined, rf"{slot}(?: {slot})+", slot)
    return F.split(lined, " ")


def windows(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """One row per window of ``size`` words of the array ``_t``: its place and hash. No array is kept."""
    count = F.size("_t") - (size - 1)
    zipped = F.arrays_zip(*[F.slice("_t", 1 + k, F.greatest(count, F.lit(0))).alias(f"w{k}") for k in range(size)])
    opened = unfold(rows, keep, F.when(count > 0, zipped), "_g", "_at")
    return opened.select(*keep, "_at", F.xxhash64(F.lit(size), *[F.col(f"_g.w{k}") for k in range(size)]).alias("_hash"))


def templates(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key).alias("_key"), template(text_or_empty(text)).alias("_t"))


def occurrences(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, coverage, slots, exact: the best occurrence of each item in each document."""
    items = benchmark.select(F.col(item_id).alias("item_id"), template(text_or_empty(text)).alias("_t"), words(text_or_empty(text)).alias("_iw"))
    items = items.distinct().withColumn("_item", F.xxhash64("item_id", "_iw")).withColumn("_n", F.size("_t")).filter(F.col("_n") >= LEAST).withColumn("_size", F.when(F.col("_n") < window, F.col("_n")).otherwise(F.lit(min(PIECE, window))))
    least = F.greatest(F.least(F.ceil(F.col("_n") * share), F.lit(QUOTED)), F.least("_n", F.lit(window)))
    items = cut_lineage(items.withColumn("_least", least.cast("int")))
    sizes = [r["_size"] for r in items.select("_size").distinct().collect()]  # at most ``window`` values
    parts = templates(docs, doc_id, text)
    hits = None
    for size in sizes:
        own = windows(items.filter(F.col("_size") == size), ["item_id", "_item"], size)
        own = cut_lineage(own.select("item_id", "_item", F.col("_at").alias("_item_at"), "_hash"))
        found = windows(parts, ["_key"], size).join(small_enough(own), "_hash")
        part = found.select(F.col("_key").alias("doc_id"), "item_id", "_item", (F.col("_at") - F.col("_item_at")).alias("_diagonal"), "_item_at")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"), F.lit(0).alias("slots"), F.lit(True).alias("exact")).limit(0)
    # The places of an item bound the set, however often a document repeats the passage.
    runs = hits.groupBy("doc_id", "item_id", "_item", "_diagonal").agg(F.collect_set("_item_at").alias("_places"))
    # Every diagonal for itself, and twice with its neighbours: those at most SHIFT apart meet once at least.
    wide = 2 * SHIFT
    near = [F.col("_diagonal"), F.floor(F.col("_diagonal") / wide), F.floor((F.col("_diagonal") + SHIFT) / wide)]
    near = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), d.cast("long").alias("d")) for k, d in enumerate(near)]))
    runs = runs.select("doc_id", "item_id", "_item", F.struct(F.size("_places").alias("size"), F.col("_diagonal").alias("diagonal"), F.col("_places").alias("places")).alias("_run"), near.alias("_near"))
    seen = runs.groupBy("doc_id", "item_id", "_item", "_near").agg(F.collect_list("_run").alias("_runs"))
    seen = seen.join(small_enough(items.select("_item", "_n", "_size", "_least").distinct()), "_item")
    seen = seen.withColumn("_covered", covered(F.flatten("_runs.places"))).filter(F.size("_covered") >= F.col("_least"))
    seen = cut_lineage(seen.drop("_near", "_size", "_least"))
    judged = slot_values(seen, docs, items, doc_id, text)
    best = F.max(F.struct("exact", "coverage", "slots"))
    return judged.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.coverage", "b.slots", "b.exact")


def covered(places: Column) -> Column:
    """The places of the words in the windows at ``places``."""
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.col("_size") - 1))))


def slot_values(seen: DataFrame, docs: DataFrame, items: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, item_id, coverage, slots, exact of the occurrences ``seen`` whose slots are consistent.

    A slot is read on the diagonal that covers it with the most windows. Only occurrences of items with slots read
    their documents once more.
    """
    placed = seen.join(small_enough(items.select("_item", "_t", "_iw", "_size")), "_item")
    slots = F.filter("_covered", lambda p: F.element_at("_t", p + 1).startswith("<"))
    runs = F.reverse(F.array_sort("_runs"))
    covers = lambda run, p: F.exists(run["places"], lambda w: (w <= p) & (p < w + F.col("_size")))
    slots = F.transform(slots, lambda p: F.struct(p.alias("p"), F.element_at(F.filter(runs, lambda r: covers(r, p)), 1)["diagonal"].alias("d")))
    placed = placed.select("doc_id", "item_id", (F.size("_covered") / F.col("_n")).alias("coverage"), slots.alias("_slots"), "_iw")
    plain = placed.filter(F.size("_slots") == 0).select("doc_id", "item_id", "coverage", F.lit(0).alias("slots"), F.lit(True).alias("exact"))
    slotted = cut_lineage(placed.filter(F.size("_slots") > 0))
    wanted = small_enough(cut_lineage(slotted.select(F.col("doc_id").alias("_id")).distinct()))
    read = docs.join(wanted, F.col(doc_id).eqNullSafe(F.col("_id")), "left_semi").select(F.col(doc_id).alias("_id"), words(text_or_empty(text)).alias("_w")).distinct()
    pairs = F.transform("_slots", lambda s: F.struct(F.element_at("_iw", s["p"] + 1).alias("i"), F.try_element_at("_w", s["p"] + s["d"] + 1).alias("d")))
    known = slotted.join(read, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_pairs", F.array_distinct(pairs))
    values = F.size(F.array_distinct(F.transform("_pairs", lambda p: p["i"])))
    known = known.filter(values == F.size("_pairs"))
    known = known.select("doc_id", "item_id", "coverage", F.size("_pairs").alias("slots"), F.forall("_pairs", lambda p: p["i"].eqNullSafe(p["d"])).alias("exact"))
    return plain.unionByName(known)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return occurrences(documents(spark, sf_dir).select("doc_id", "text"), benchmark)


QUERIES = {"op3_decontaminate": op3_decontaminate}


def _sql_template(text: str) -> str:
    # DuckDB has no look-behind: a slot word is matched with a blank on both sides, blanks being doubled.
    lined = rf"' ' || replace(trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' '"
    for alternatives, slot in ((r"\p{N}+|" + "|".join(NUMBER_WORDS), "<num>"), ("|".join(UNITS), "<unit>"), ("|".join(NAMES), "<name>")):
        lined = f"regexp_replace({lined}, ' (?:{alternatives}) ', ' {slot} ', 'g')"
    return f"string_split(replace(trim({lined}), '  ', ' '), ' ')"


_WORDS = r"regexp_extract_all(lower(coalesce({t}, '')), '[\p{{L}}\p{{N}}]+')"
ORACLES = {
    "op3_decontaminate": rf"""
WITH items AS (
  SELECT item_id, {_sql_template("coalesce(text, '')")} AS t, {_WORDS.format(t="text")} AS w FROM benchmark),
sized AS (SELECT *, len(t) AS n, least(len(t), {WINDOW}) AS size FROM items WHERE len(t) >= {LEAST}),
own AS (
  SELECT item_id, size, n - size + 1 AS windows, u.pos AS item_at, list_slice(t, u.pos, u.pos + size - 1) AS g, t, w
  FROM sized, unnest(range(1, n - size + 2)) AS u(pos)),
docs AS (
  SELECT DISTINCT doc_id, {_sql_template("coalesce(text, '')")} AS t, {_WORDS.format(t="text")} AS w FROM documents),
theirs AS (
  SELECT doc_id, s.size, u.pos, list_slice(t, u.pos, u.pos + s.size - 1) AS g
  FROM docs, (SELECT DISTINCT size FROM sized) s, unnest(range(1, greatest(len(t) - s.size + 2, 1))) AS u(pos)),
hits AS (
  SELECT DISTINCT d.doc_id, o.item_id, o.item_at, d.pos - o.item_at AS diagonal, o.windows, o.size
  FROM theirs d JOIN own o ON d.size = o.size AND d.g = o.g),
seen AS (
  SELECT doc_id, item_id, diagonal, count(*) AS seen, max(windows) AS windows FROM hits
  GROUP BY ALL HAVING count(*) >= max(windows) * {COVERAGE}),
slotted AS (
  SELECT DISTINCT h.doc_id, h.item_id, h.diagonal, i.w[p.k] AS i, d.w[p.k + h.diagonal] AS d
  FROM hits h JOIN items i ON h.item_id = i.item_id JOIN docs d ON h.doc_id = d.doc_id,
       unnest(range(h.item_at, h.item_at + h.size)) AS p(k)
  WHERE starts_with(i.t[p.k], '<')),
judged AS (
  SELECT doc_id, item_id, diagonal, count(DISTINCT i) AS vals, count(*) AS slots, bool_and(i = d) AS same FROM slotted GROUP BY ALL),
good AS (
  SELECT s.doc_id, s.item_id, s.seen / s.windows AS coverage, coalesce(j.slots, 0) AS slots, coalesce(j.same, true) AS exact
  FROM seen s LEFT JOIN judged j ON s.doc_id = j.doc_id AND s.item_id = j.item_id AND s.diagonal = j.diagonal
  WHERE coalesce(j.vals, 0) = coalesce(j.slots, 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY exact DESC, coverage DESC, slots DESC) AS r FROM good)
SELECT doc_id, item_id, coverage, CAST(slots AS INTEGER) AS slots, exact FROM placed WHERE r = 1"""
}
