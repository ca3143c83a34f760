"""Benchmark decontamination with a positional index; DataFrame functions only.

Postings are (term, document, positions). For every benchmark window its terms are ordered from the rarest in the corpus.
The rarest term's positions, shifted by its place in the window, are the possible begins of the window in a document; the
lists of the next terms, shifted likewise, are intersected with them. What remains is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import few, keep, row_key

# Words are runs of 0-9, a-z (after lower-casing A-Z) and everything beyond ASCII; all else becomes a space.
CHANGED = "".join(c for c in map(chr, range(128)) if not (c.isdigit() or c.islower()))
CHANGED_TO = "".join(c.lower() if c.isupper() else " " for c in CHANGED)
# Lists that are intersected per window, counted from the rarest term, before words are compared.
LISTS = 2
# Terms that are looked up in one pass over the documents, which is what bounds the broadcast; more of them take more passes.
TERMS_AT_ONCE = 500_000


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    parts = F.split(F.translate(text, CHANGED, CHANGED_TO), " ")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, size: int = 10, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The different windows of all items, (window, terms), and which items have them, (window, item).

    A window is ``size`` words in a row; an item of fewer words, but not none, is one window. window is a hash of the words.
    """
    items = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    begins = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    cut = items.select("item", "w", begins.alias("at")).select("item", F.slice("w", F.col("at"), F.lit(size)).alias("terms"))
    cut = cut.withColumn("window", F.xxhash64("terms")).distinct()
    return cut.select("window", "terms").dropDuplicates(["window"]), cut.select("window", "item").distinct()


def postings(docs: DataFrame, key: list[str], text: str, terms: DataFrame) -> DataFrame:
    """(key..., position, term) for every occurrence of the given terms (a written table of different ``term`` values).

    The terms are broadcast, ``TERMS_AT_ONCE`` at a time, so that other words and frequent words are never shuffled.
    """
    passes = terms.count() // TERMS_AT_ONCE + 1
    placed = docs.select(*key, F.posexplode(words(F.col(text))).alias("position", "term"))
    whole = None
    for i in range(passes):
        some = terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i) if passes > 1 else terms
        part = placed.join(F.broadcast(some), "term")
        whole = part if whole is None else whole.union(part)
    return whole


def anchors(found: DataFrame, frequencies: DataFrame, lists: int = LISTS) -> DataFrame:
    """(window, rank, term, offset): each window's ``lists`` rarest different terms and the place of their first use in it."""
    places = found.select("window", F.posexplode("terms").alias("offset", "term")).groupBy("window", "term").agg(F.min("offset").alias("offset"))
    rarest = Window.partitionBy("window").orderBy("n", "term")
    ranked = places.join(frequencies, "term").withColumn("rank", F.row_number().over(rarest))
    return ranked.where(F.col("rank") <= lists).select("window", "rank", "term", "offset")


def occurrences(docs: DataFrame, key: list[str], text: str, wanted: DataFrame, slop: int | None = None) -> DataFrame:
    """(key..., window, start, length): where each window stands in ``docs``, from 0; ``key`` tells texts apart and is not null.

    With ``slop``, proximity matches (key..., window, start) instead: places at which each word of the window, repeats included, is found at most
    ``slop`` words from where the first use of the rarest one would have it.
    Terms that the corpus does not have rule their windows out at once. Frequencies come from partial counts of the
    windows' terms alone, and only the rarest terms' postings are kept, so frequent words are never shuffled.
    """
    vocabulary = keep(wanted.select(F.explode("terms").alias("term")).distinct(), "terms")
    counted = keep(postings(docs, [], text, vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "frequencies")
    absent = wanted.select("window", F.explode("terms").alias("term")).join(counted, "term", "left_anti").select("window").distinct()
    possible = wanted.join(absent, "window", "left_anti")
    rare = keep(anchors(possible, counted), "anchors")
    terms = keep(rare.select("term").distinct(), "rare-terms")
    stored = keep(postings(docs, key, text, terms), "postings")
    shifted = stored.join(few(rare), "term").select(*key, "window", "rank", (F.col("position") - F.col("offset")).alias("start"))
    lists = few(rare.groupBy("window").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("lists")))
    if slop is not None:
        first = shifted.where("rank = 1").select(*key, "window", "start")
        near = F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)).alias("start")
        around = first.select(*key, "window", F.col("start").alias("begin"), near)
        met = around.join(shifted, [*key, "window", "start"]).groupBy(*key, "window", "begin").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("met"))
        candidates = met.join(lists, "window").where("met = lists").select(*key, "window", F.col("begin").alias("start"))
    else:
        met = shifted.where("start >= 0").groupBy(*key, "window", "start").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("met"))
        candidates = met.join(lists, "window").where("met = lists").select(*key, "window", "start")
    candidates = keep(candidates, "candidates")
    texts = docs.select(*key, F.col(text).alias("__text")).join(few(candidates.select(*key).distinct()), key, "left_semi")
    starts = candidates.groupBy(*key).agg(F.collect_list(F.struct("window", "start")).alias("c"))  # places in one text
    terms = candidates.select(*key, "window").distinct().join(few(wanted), "window")
    terms = terms.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("window", "terms"))).alias("t"))
    lined = texts.select(*key, words(F.col("__text")).alias("w")).join(starts, key).join(terms, key)

    def holds(c: Column) -> Column:
        mine = F.element_at("t", c.window)
        if slop is None:
            return F.slice(F.col("w"), c.start + 1, F.size(mine)) == mine

        def found(term: Column, k: Column) -> Column:
            begin = F.greatest(F.lit(1), c.start + k + 1 - slop)
            return F.array_contains(F.slice(F.col("w"), begin, F.greatest(F.lit(0), c.start + k + 2 + slop - begin)), term)

        return F.forall(F.transform(mine, found), lambda x: x)

    held = lined.select(*key, F.explode(F.filter("c", holds)).alias("c"), "t").select(*key, "c.window", "c.start", F.size(F.element_at("t", F.col("c.window"))).alias("length"))
    return (held if slop is None else held.drop("length")).distinct()


def hits(found: DataFrame, key: list[str], items: DataFrame) -> DataFrame:
    """(key..., n_hit, n_items, items_sha256) of every text with an occurrence; overlapping windows count a word once."""
    spans = found.withColumn("end", F.col("start") + F.col("length"))
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.withColumn("new", F.greatest(fresh, F.lit(0))).groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    named = found.select(*key, "window").distinct().join(few(items), "window").select(*key, F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy(*key).agg(F.count("item").alias("n_items"), F.array_sort(F.collect_list("item")).alias("names"))
    digest = F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256")
    return covered.join(named, key).select(*key, "n_hit", "n_items", digest)


def contamination(docs: DataFrame, benchmark: DataFrame, row: str = "doc_id", text: str = "text", size: int = 10, item: str = "item_id") -> DataFrame:
    """(row, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Rows that agree in id and text have the same result, once per row. Null texts have no words; benchmark rows without
    words have no window; an occurrence of an item with a null id counts as hit, but not as an item.
    """
    keys = row_key(F.col(row), F.col(text))
    keyed = docs.select(F.col(row).alias("row"), F.col(text).alias("text"), *keys)
    key = ["__k1", "__k2"]
    wanted, items = windows(benchmark, size, item)
    wanted, items = keep(wanted, "windows"), keep(items, "items")
    found = keep(occurrences(keyed, key, "text", wanted), "occurrences")
    counts = keyed.select("row", *key, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    whole = counts.join(hits(found, key, items), key, "left")
    return whole.select(
        F.col("row").alias(row),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, row: str = "doc_id", text: str = "text", size: int = 10, item: str = "item_id") -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; columns as they are."""
    named = dict(zip(["__k1", "__k2"], row_key(F.col(row), F.col(text)), strict=True))
    keyed = docs.withColumns(named)
    wanted = keep(windows(benchmark, size, item)[0], "windows")
    found = keep(occurrences(keyed, list(named), text, wanted).select(*named).distinct(), "contaminated")
    return keyed.join(found, list(named), "left_anti").drop(*named)
