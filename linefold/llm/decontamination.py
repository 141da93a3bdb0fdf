"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. ``build_index`` stores the postings (word, document, position) of the training texts; for a search only the words
   that the test items use are stored. Each task writes the postings of its own documents: nothing is shuffled.
2. Document frequencies come from the index. Every window of an item picks its ``RAREST`` rarest words.
3. The postings of these words, adjusted by their offsets in the item, are intersected: an alignment (document, item,
   shift) stays if all rarest words of one of its windows are there. Frequent words are never looked up.
4. The places of the text under the alignments of an item are compared with its windows, each place once, and hits are
   counted as the union of spans.

``proximity_matches`` intersects the same postings within a distance instead of at fixed offsets.

Documents are keyed by a 64-bit hash of id and text; a clash could only add an alignment, which step 4 refuses. Rows with equal id
and text get equal results, a row each. Null and empty texts have no words and no hits. Items without words take no
part; items without an id count for hits, but aren't listed. Equal items are searched once. A vocabulary too large to broadcast
joins by shuffle, where adaptive execution splits the postings of frequent words. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linefold.llm.store import small, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAREST = 2


def words_of(text: Column) -> Column:
    """Runs of digits, letters and everything beyond ASCII; A-Z lower-cased; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda word: word != "")


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(F.xxhash64(id_column, text).alias("doc"), F.col(id_column).alias("id"), text.alias("text"))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Store the postings (word, doc, pos) of ``docs(doc, text)``, of all words or of those in ``vocabulary(word)``."""
    postings = docs.select("doc", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    if vocabulary is not None:
        postings = postings.join(small(vocabulary), "word")
    return stage(postings.select("word", "doc", "pos"), "postings")


def windows_of(words: Column, window: int) -> Column:
    """The distinct windows of an item, as joined words."""
    length = F.least(F.size(words), F.lit(window))
    starts = F.sequence(F.lit(0), F.size(words) - length)
    return F.array_distinct(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, length), " ")))


def test_items(items: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """(item, words, ids, grams) of the distinct items that have words, with their windows as ``grams``."""
    rows = items.select(F.col(id_column).cast("string").alias("id"), words_of(F.col(text_column)).alias("words"))
    rows = rows.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("id").alias("ids"))
    return stage(rows.select(F.xxhash64("words").alias("item"), "words", "ids", windows_of(F.col("words"), window).alias("grams")), "items")


def rarest(tests: DataFrame, frequencies: DataFrame, window: int) -> DataFrame:
    """(item, picks): for each window that can occur, the places of its rarest words."""
    places = tests.select("item", F.posexplode("words").alias("pos", "word")).join(frequencies, "word", "left")
    place = F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "word")
    listed = places.groupBy("item").agg(F.array_sort(F.collect_list(place)).alias("places"))
    last = F.greatest(F.size("places") - window, F.lit(0))

    def picks(start: Column) -> Column:
        inside = F.slice("places", start + 1, F.lit(window))
        by_rarity = F.array_sort(F.transform(inside, lambda p: F.struct(p["n"], p["word"], p["pos"])))
        return F.when(by_rarity[0]["n"] > 0, F.transform(F.slice(by_rarity, 1, RAREST), lambda p: p["pos"]))

    def gram(start: Column) -> Column:
        return F.array_join(F.transform(F.slice("places", start + 1, F.lit(window)), lambda p: p["word"]), " ")

    starts = F.transform(F.sequence(F.lit(0), last), lambda s: F.struct(gram(s).alias("gram"), s.alias("start"), picks(s).alias("pick")))
    # equal windows of an item are looked for once, or an item that repeats itself would meet a text that does at every place
    windows = listed.select("item", F.inline(starts)).groupBy("item", "gram").agg(F.min_by("pick", "start").alias("pick"))
    return windows.where("pick is not null").groupBy("item").agg(F.collect_set("pick").alias("picks"))


def alignments(index: DataFrame, tests: DataFrame, window: int) -> DataFrame:
    """(doc, item, shift) where the rarest words of some window all stand at their offsets."""
    frequencies = index.groupBy("word").agg(F.count("*").alias("n"))
    picks = stage(rarest(tests, frequencies, window), "picks")
    anchors = picks.select("item", F.explode(F.array_distinct(F.flatten("picks"))).alias("at"))
    anchors = anchors.join(tests, "item").select("item", "at", F.col("words")[F.col("at")].alias("word"))
    placed = index.join(small(anchors), "word").select("doc", "item", (F.col("pos") - F.col("at")).alias("shift"), "at")
    met = placed.groupBy("doc", "item", "shift").agg(F.collect_set("at").alias("met"))
    met = met.where(F.size("met") >= 1).join(small(picks), "item")
    whole = F.exists("picks", lambda pick: F.forall(pick, lambda at: F.array_contains("met", at)))
    return met.where(whole).select("doc", "item", "shift")


def window_starts(words: Column, size: Column, grams: Column, shifts: Column, window: int) -> Column:
    """Ascending places in the document, under an item of ``size`` words moved by the sorted ``shifts``, at which one of its windows starts."""
    length = F.least(size, F.lit(window))
    span = size - length

    def under(shift: Column, i: Column) -> Column:
        # what lies under the shift before is not looked at again
        after = F.when(i > 0, F.element_at(shifts, F.greatest(i, F.lit(1))) + span + 1).otherwise(0)
        low, high = F.greatest(F.lit(0), shift, after), F.least(shift + span, F.size(words) - length)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    places = F.flatten(F.transform(shifts, under))
    return F.filter(places, lambda p: F.array_contains(grams, F.array_join(F.slice(words, p + 1, length), " ")))


def words_inside(spans: Column) -> Column:
    """How many places the spans (start, stop) cover."""
    none = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        none,
        lambda acc, x: F.struct(
            F.greatest(acc["stop"], x["stop"]).alias("stop"),
            (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["stop"], x["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20, id_column: str = "doc_id",
    text_column: str = "text", item_column: str = "item_id",
) -> DataFrame:
    """Hits of the items' windows in each document.

    ``contaminated``: some word is hit, and at least one in ``one_in`` words. ``items`` lists the ids with a hit.
    """
    texts = keyed(docs, id_column, text_column)
    tests = test_items(items, item_column, text_column, window)
    vocabulary = stage(tests.select(F.explode("words").alias("word")).distinct(), "vocabulary")
    index = build_index(texts.select("doc", "text"), vocabulary)
    found = alignments(index, tests, window)
    found = found.groupBy("doc", "item").agg(F.array_sort(F.collect_list("shift")).alias("shifts"))
    found = found.join(small(tests.select("item", F.size("words").alias("size"), "grams", "ids")), "item")
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("shifts", "size", "grams", "ids")).alias("found"))

    rows = texts.join(per_doc, "doc", "left").select("id", words_of(F.col("text")).alias("words"), "found")
    hits = F.transform(
        F.coalesce("found", F.array()),
        lambda x: F.struct(
            window_starts(F.col("words"), x["size"], x["grams"], x["shifts"], window).alias("starts"),
            F.least(x["size"], F.lit(window)).alias("length"),
            x["ids"].alias("ids"),
        ),
    )
    rows = rows.select("id", F.size("words").alias("n_words"), F.filter(hits, lambda h: F.size(h["starts"]) > 0).alias("hits"))
    spans = F.flatten(
        F.transform("hits", lambda h: F.transform(h["starts"], lambda s: F.struct(s.alias("start"), (s + h["length"]).alias("stop"))))
    )
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["ids"]))))
    rows = rows.select(
        F.col("id").alias(id_column),
        F.col("n_words").cast("long").alias("n_words"),
        words_inside(spans).cast("long").alias("n_hit"),
        listed.alias("items"),
    )
    enough = (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))
    return rows.withColumn("contaminated", enough)


def proximity_matches(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query, doc, pos) of ``queries(query, words)``: a place of a query's rarest word with all its words within ``within`` words.

    The rarest word's postings are the candidates; postings of the other words meet them by document and by block of
    positions.
    """
    words = stage(queries.select("query", F.explode(F.array_distinct("words")).alias("word")), "terms")
    postings = index.join(small(words), "word")
    frequencies = postings.groupBy("query", "word").agg(F.count("*").alias("n"))
    listed = words.join(frequencies, ["query", "word"], "left").groupBy("query").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("low"), F.count("*").alias("many")
    )
    listed = small(listed.select("query", F.col("low.word").alias("low"), "many").where("low is not null"))
    placed = postings.join(listed, "query").withColumn("block", F.floor(F.col("pos") / (within + 1)))
    low = placed.where("word = low").select("query", "doc", "many", F.col("pos").alias("at"), F.col("block").alias("of"))
    near = low.withColumn("block", F.explode(F.array(F.col("of") - 1, F.col("of"), F.col("of") + 1)))
    met = near.join(placed.select("query", "doc", "block", "word", "pos"), ["query", "doc", "block"])
    met = met.where(F.abs(F.col("pos") - F.col("at")) <= within).groupBy("query", "doc", "at", "many")
    whole = met.agg(F.count_distinct("word").alias("n")).where("n = many")
    return whole.select("query", "doc", F.col("at").alias("pos"))
