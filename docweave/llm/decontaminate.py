"""Benchmark decontamination on templates.

Words become template tokens: numbers, units and names turn into typed placeholders, all else is
lower-cased. Windows of template tokens of the texts are hash-joined with those of the benchmark.
An item counts as leaked into a text if enough of its windows are there and its slots map
consistently: one value of the item to one value of the text throughout, and the other way round.
So a question with other numbers is caught, and an unrelated text with the same phrases is not.

Windows are compared in two forms, with names typed and with names as plain lower-cased words, so
passages in capitals are found as well. Slots are checked for each place of an item in a text, and
for all places together. ``as_sql`` leaves both out, as the SQL of op6 does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import bounded, cut_lineage

WINDOW = 5
LEAST_LITERALS = 3
LEAST_SHARE = 0.8

#: Unit words.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons lb lbs ounce ounces ml l litre litres "
    "liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars cent cents euro euros pound pounds mph kmh watt watts volt volts"
).split()

# Each pattern with its replacement, in order: names (a capital within a sentence), digit groups, a unit stuck to a number.
MARKS = (
    (r"([^.!?:\x20\x09-\x0D][\x20\x09-\x0D])(\p{Lu})", "$1^$2"),
    (r"([0-9])[.,]([0-9])", "$1$2"),
    (r"([0-9])(\p{L})", "$1 $2"),
)
OTHER_SIGNS = r"[^\p{L}\p{M}\p{N}^]+"


def raw_tokens(text: Column) -> Column:
    """Lower-cased words without punctuation; names start with ``^``."""
    for pattern, replacement in MARKS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.filter(F.split(F.regexp_replace(F.lower(text), OTHER_SIGNS, " "), " "), lambda w: (w != "") & (w != "^"))


def template(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return F.when(first.between("0", "9"), "<num>").when(first == "^", "<name>").when(word.isin(*UNITS), "<unit>").otherwise(word)


def _windows(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (with ``raw``) with one row per window of ``size`` tokens: its place ``at`` and hash.

    The outer form of the generator keeps the optimizer from filtering on the hashes before it,
    which would work them out twice; rows without windows have a null hash and join nothing.
    """
    hashed = lambda typed: F.transform(
        F.sequence(F.lit(0), F.size(typed) - size), lambda i: F.xxhash64(*[F.get(typed, i + k) for k in range(size)])
    )
    hashes = F.element_at(F.transform(F.array(F.transform("raw", template)), hashed), 1)
    rows = rows.withColumn("hashes", F.when(F.size("raw") >= size, hashes))
    return rows.select(*[c for c in rows.columns if c != "hashes"], F.posexplode_outer("hashes").alias("at", "hash"))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int, longest: bool) -> DataFrame:
    """The windows of the items with at least ``LEAST_LITERALS`` plain words.

    ``longest`` takes the items with ``size`` tokens or more, otherwise those with exactly ``size``.
    """
    items = benchmark.select(benchmark[id_col].alias("item_id"), raw_tokens(F.coalesce(benchmark[text_col], F.lit(""))).alias("raw"))
    items = items.filter(F.size("raw") >= size if longest else F.size("raw") == size)
    rows = _windows(items, size).filter("hash is not null")
    rows = rows.select("item_id", F.col("at").alias("item_at"), F.col("hash").alias("item_hash"), F.slice("raw", F.col("at") + 1, size).alias("item_raw"))
    literals = F.size(F.filter("item_raw", lambda w: ~template(w).startswith("<")))
    rows = rows.filter(literals >= min(LEAST_LITERALS, size))
    counts = rows.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    return rows.join(counts, "item_id")


def _bare(word: Column) -> Column:
    return F.ltrim(word, F.lit("^"))


def plain_template(word: Column) -> Column:
    """Names are plain words; numbers and units are typed."""
    return template(_bare(word))


def _windows_of_forms(rows: DataFrame, size: int) -> DataFrame:
    """As ``_windows``, with each window in both forms: typed, and ``plain``."""
    hashed = lambda kinds: F.transform(
        F.sequence(F.lit(0), F.size(kinds) - size), lambda i: F.xxhash64(*[F.get(kinds, i + k) for k in range(size)])
    )
    hashes = F.flatten(F.transform(F.array(F.transform("raw", template), F.transform("raw", plain_template)), hashed))
    cut = rows.withColumn("hashes", F.when(F.size("raw") >= size, hashes))
    cut = cut.select(*rows.columns, F.posexplode_outer("hashes").alias("__at", "hash"))
    n = F.size("raw") - size + 1
    return cut.select(*rows.columns, (F.col("__at") % n).alias("at"), (F.col("__at") >= n).alias("plain"), "hash")


def _item_forms(items: DataFrame, size: int, longest: bool) -> DataFrame:
    """The windows of distinct items (by id and text, null ids too) with enough plain words, in both forms where they differ."""
    rows = items.select("item_id", F.xxhash64("item_id", F.col("item_id").isNull(), F.coalesce("text", F.lit(""))).alias("item_key"), "text")
    rows = rows.dropDuplicates(["item_key"]).select("item_id", "item_key", raw_tokens(F.coalesce("text", F.lit(""))).alias("raw"))
    rows = _windows_of_forms(rows.filter(F.size("raw") >= size if longest else F.size("raw") == size), size).filter("hash is not null")
    rows = rows.withColumn("item_raw", F.slice("raw", F.col("at") + 1, size))
    literals = lambda kind: F.size(F.filter("item_raw", lambda w: ~kind(w).startswith("<")))
    rows = rows.filter(F.when(F.col("plain"), literals(plain_template)).otherwise(literals(template)) >= min(LEAST_LITERALS, size))
    counts = rows.groupBy("item_key").agg(F.count_if(~F.col("plain")).alias("n_typed"), F.count_distinct("at").alias("n_any"))
    rows = rows.filter(~F.col("plain") | F.exists("item_raw", lambda w: w.startswith("^")))
    rows = rows.select("item_id", "item_key", F.col("at").alias("item_at"), F.col("plain").alias("item_plain"), F.col("hash").alias("item_hash"), "item_raw")
    return rows.join(counts, "item_key")


def _leaks_by_place(texts: DataFrame, items: DataFrame, sizes: list[tuple[int, bool]], least_share: float) -> DataFrame:
    """``leaks`` over both forms; an item leaked if any of its places in the text, or all together, pass."""
    hits = None
    for size, longest in sizes:
        found = _windows_of_forms(texts, size).join(bounded(_item_forms(items, size, longest)), F.col("hash") == F.col("item_hash"))
        found = found.withColumn("typed", ~F.col("plain") & ~F.col("item_plain"))
        slot = lambda k: F.struct(
            F.when(F.col("typed"), template(F.get("item_raw", k))).otherwise(plain_template(F.get("item_raw", k))).alias("kind"),
            _bare(F.get("item_raw", k)).alias("item"),
            _bare(F.get("raw", F.col("at") + k)).alias("doc"),
        )
        slots = F.filter(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), slot), lambda s: s["kind"].startswith("<"))
        place = (F.col("at") - F.col("item_at")).alias("place")
        found = found.select("doc_id", "text_hash", "item_id", "item_key", "n_typed", "n_any", place, "item_at", "typed", slots.alias("slots"))
        hits = found if hits is None else hits.union(found)
    whole = ["doc_id", "text_hash", "item_id", "item_key", "n_typed", "n_any"]
    merged = lambda name: F.array_distinct(F.flatten(F.collect_set(name))).alias(name)
    placed = hits.groupBy(*whole, "place").agg(
        F.collect_set(F.when(F.col("typed"), F.col("item_at"))).alias("typed_at"),
        F.collect_set("item_at").alias("any_at"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("typed"), F.col("slots"))))).alias("typed_slots"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("any_slots"),
    )
    pooled = placed.groupBy(*whole).agg(*[merged(c) for c in ("typed_at", "any_at", "typed_slots", "any_slots")])
    tested = placed.drop("place").unionByName(pooled)

    def share(form: str) -> Column:
        slots, part = F.col(f"{form}_slots"), F.size(f"{form}_at") / F.nullif(F.col(f"n_{form}"), F.lit(0))
        side = lambda name: F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s[name]))))
        return F.when((side("item") == F.size(slots)) & (side("doc") == F.size(slots)) & (part >= least_share), part)

    passed = tested.select(*whole, F.greatest(share("typed"), share("any")).alias("share")).filter("share is not null")
    return passed.groupBy("doc_id", "text_hash", "item_id").agg(F.max("share").alias("share"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    least_share: float = LEAST_SHARE,
    as_sql: bool = False,
) -> DataFrame:
    """``doc_id, text_hash, item_id, share``: the items that leaked into a text, with the share of their windows found.

    An item of fewer than ``window`` tokens is one window of its own size. Null and empty texts and
    items have no windows; items without a window of enough plain words cannot leak; items are
    told apart by id and text, repeated ones count once (with ``as_sql`` they are not told apart, and
    their windows are counted together); repeated rows of documents give one row. The benchmark's windows are
    broadcast only while they are few (counted first); beyond that the join shuffles.
    """
    texts = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    texts = texts.select("doc_id", "text_hash", raw_tokens(F.coalesce("text", F.lit(""))).alias("raw"))
    items = benchmark.select(benchmark[item_id_col].alias("item_id"), benchmark[item_text_col].alias("text"))
    short = items.select(F.size(raw_tokens(F.coalesce("text", F.lit("")))).alias("n")).filter(f"n between 1 and {window - 1}").distinct()
    sizes = [(window, True), *((r["n"], False) for r in short.orderBy("n").collect())]  # fewer than `window` sizes
    if not as_sql:
        return _leaks_by_place(texts, items, sizes, least_share)
    hits = None
    for size, longest in sizes:
        known = bounded(item_windows(items, "item_id", "text", size, longest))
        found = _windows(texts, size).join(known, F.col("hash") == F.col("item_hash"))
        pairs = F.filter(
            F.transform(
                F.sequence(F.lit(0), F.lit(size - 1)),
                lambda k: F.struct(template(F.get("item_raw", k)).alias("kind"), F.get("item_raw", k).alias("item"), F.get("raw", F.col("at") + k).alias("doc")),
            ),
            lambda s: s["kind"].startswith("<"),
        )
        found = found.select("doc_id", "text_hash", "item_id", "item_windows", "item_at", pairs.alias("slots"))
        hits = found if hits is None else hits.union(found)
    # copies of a passage within a text are one row per item window before the shuffle
    by_window = hits.groupBy("doc_id", "text_hash", "item_id", "item_windows", "item_at").agg(F.flatten(F.collect_set("slots")).alias("slots"))
    by_item = by_window.groupBy("doc_id", "text_hash", "item_id", "item_windows").agg(
        F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots")
    )
    side = lambda name: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s[name]))))
    consistent = (side("item") == F.size("slots")) & (side("doc") == F.size("slots"))
    share = F.col("n") / F.col("item_windows")
    return by_item.filter(consistent & (share >= least_share)).select("doc_id", "text_hash", "item_id", share.alias("share"))


def marked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``items``, the sorted ids of the items that leaked into each row's text (often empty).

    Rows that share an id are told apart by a hash of their text. A column ``items`` or
    ``__hash`` of the input is an error of the caller, as it would be lost.
    """
    found = leaks(docs, benchmark, id_col, text_col, **options)
    listed = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.transform(F.collect_set(F.struct("item_id")), lambda i: i["item_id"])).alias("items"))
    # worked out once: counting it for the broadcast would search all texts, and the join again
    listed = cut_lineage(listed.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text"), "items"))
    keyed = docs.withColumn("__hash", F.xxhash64(text_col))
    joined = keyed.join(bounded(listed), keyed[id_col].eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__text")), "left")
    return joined.select(*[keyed[c] for c in docs.columns], F.coalesce("items", F.array().cast(listed.schema["items"].dataType)).alias("items"))
