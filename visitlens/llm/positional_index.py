"""Benchmark decontamination by a distributed positional inverted index.

DataFrame functions only. ``postings`` stores one row per training token of the wanted
vocabulary: document, position, word. A query is a window of words. The rarest word of a
window, by its count in the index, gives candidate places: its positions, less its offset in
the window. The list of the second rarest word, adjusted by its own offset, is intersected
first, and only places that pass read the lists of the other words. ``phrases`` returns exact
occurrences, ``near`` documents that hold an item's rarest words close together in any order.

The vocabulary, the windows and the places that are left are stored, so Spark knows their
size and broadcasts them only below its threshold; beyond it the joins are shuffled by word
or by document and position, and Spark splits a frequent word at run time.

Defined cases: words are maximal runs of digits, letters and characters beyond ASCII, after
lower-casing A-Z. A null text has no words; a document or item without words matches
nothing. Rows that repeat id and text get equal results, one each; rows that repeat an id
with another text are documents of their own. A null document id is an id like others. Items
that share an id count once; a null item id counts as an item whose id is empty text. Empty
tables give empty results, an empty benchmark gives documents without hits. Other columns of
the inputs are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.llm.common import UPPER, stored

# Fixed value: what separates words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
DOC = ["d", "h"]
WHICH = ["item", "start", "version"]
PLACE = [*DOC, *WHICH, "width", "shift"]


def words(text: str = "text") -> Column:
    """The words of a text column, in order; none for a null text."""
    lowered = F.translate(F.col(text), UPPER, UPPER.lower())
    split = F.filter(F.split(lowered, BREAK), lambda word: word != "")
    return F.coalesce(split, F.array().cast("array<string>"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and a key without nulls: rows of one key have the same id and text."""
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"),
        F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("h"),
        words().alias("words"),
    )


def postings(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``d, h, pos, word`` of every token, or of every token in ``vocabulary``; stored."""
    rows = _keyed(docs).select(*DOC, F.posexplode("words").alias("pos", "word"))
    if vocabulary is not None:
        rows = rows.join(stored(vocabulary.select("word").distinct(), "index-words"), "word")
    return stored(rows.select(*DOC, "pos", "word"), "index-postings")


def _items(benchmark: DataFrame) -> DataFrame:
    """``item, words``: ``item`` is the id as text. Equal items are one."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return benchmark.select(item, words().alias("words")).where(F.size("words") > 0).distinct()


def item_words(benchmark: DataFrame) -> DataFrame:
    """``word`` of all items, distinct."""
    return _items(benchmark).select(F.explode("words").alias("word")).distinct()


def _windows(benchmark: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """``item, start, version, width, terms``: windows all of whose words are in the index.

    ``terms`` holds ``(n, offset, word)`` from the rarest word on. ``version`` tells apart
    the texts of items that share an id.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    cut = _items(benchmark).select("item", "words", F.explode(starts).alias("start"))
    cut = cut.select("item", "start", F.slice("words", F.col("start") + 1, size).alias("words"))
    cut = cut.distinct()
    placed = cut.select("*", F.posexplode("words").alias("offset", "word"))
    ranked = (
        placed.join(counts, "word")
        .groupBy("item", "start", "words")
        .agg(F.array_sort(F.collect_list(F.struct("n", "offset", "word"))).alias("terms"))
    )
    whole = ranked.where(F.size("terms") == F.size("words"))
    return whole.select(
        "item", "start", F.xxhash64("words").alias("version"), F.size("terms").alias("width"), "terms"
    )


def phrases(index: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``d, h, item, start, version, width, shift``: exact occurrences of the items' windows.

    A window begins at word ``start`` of its item and at word ``shift`` of the document. An
    item of fewer than ``size`` words is one window.
    """
    counts = index.join(stored(item_words(benchmark), "index-asked"), "word")
    counts = stored(counts.groupBy("word").agg(F.count("*").alias("n")), "index-counts")
    windows = stored(_windows(benchmark, counts, size), "index-windows")

    first, second = F.element_at("terms", 1), F.element_at("terms", F.least(F.lit(2), F.size("terms")))
    rarest = windows.select(
        *WHICH, "width", first["word"].alias("word"), first["offset"].alias("offset"),
        second["word"].alias("next_word"), second["offset"].alias("next_offset"),
    )
    places = index.join(rarest, "word").withColumn("shift", F.col("pos") - F.col("offset"))
    adjusted = places.where("shift >= 0").select(
        *PLACE, F.col("next_word").alias("word"), (F.col("shift") + F.col("next_offset")).alias("pos")
    )
    # The second list is read for the second words alone.
    seconds = stored(rarest.select(F.col("next_word").alias("word")).distinct(), "index-seconds")
    beside = index.join(seconds, "word").select(*DOC, "pos", "word")
    passed = adjusted.join(beside, [*DOC, "pos", "word"], "left_semi")
    passed = stored(passed.select(*PLACE).distinct(), "index-places")

    terms = windows.select(*WHICH, F.explode("terms").alias("term"))
    others = passed.join(terms, WHICH).select(
        *PLACE, F.col("term.word").alias("word"), (F.col("shift") + F.col("term.offset")).alias("pos")
    )
    in_question = stored(passed.select(*DOC).distinct(), "index-documents")
    lists = index.join(in_question, DOC, "left_semi")
    found = others.join(lists, [*DOC, "pos", "word"], "left_semi")
    return found.groupBy(*PLACE).agg(F.count("*").alias("n")).where("n = width").drop("n")


def near(index: DataFrame, benchmark: DataFrame, terms: int = 3, within: int = 20) -> DataFrame:
    """``d, h, item, pos``: places from which ``within`` words hold the ``terms`` rarest
    distinct words of an item, in any order. ``pos`` is that of the first of them.

    Items with fewer distinct words ask for all they have; one with a word that the index
    lacks matches nothing.
    """
    asked = _items(benchmark).select("item", F.array_distinct("words").alias("words"))
    asked = asked.select("*", F.explode("words").alias("word"))
    counts = index.join(stored(item_words(benchmark), "near-asked"), "word")
    counts = counts.groupBy("word").agg(F.count("*").alias("n"))
    ranked = asked.join(counts, "word").groupBy("item", "words").agg(
        F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked")
    )
    whole = ranked.where(F.size("ranked") == F.size("words"))
    rare = whole.select(
        "item", F.xxhash64("words").alias("version"), F.slice("ranked", 1, terms).alias("rare")
    )
    rare = rare.select(
        "item", "version", F.size("rare").alias("wanted"), F.explode("rare.word").alias("word")
    )
    met = index.join(stored(rare, "near-terms"), "word").select(
        *DOC, "item", "version", "wanted", "pos", "word"
    )
    ahead = (
        Window.partitionBy(*DOC, "item", "version").orderBy("pos").rangeBetween(0, within - 1)
    )
    held = met.distinct().withColumn("held", F.size(F.collect_set("word").over(ahead)))
    return held.where("held = wanted").select(*DOC, "item", "pos").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items, contaminated``.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` lists the ids of
    items that have one, sorted as text.
    """
    index = postings(docs, item_words(benchmark))
    found = stored(phrases(index, benchmark, size), "index-found")
    spans = found.select(*DOC, "shift", "width").distinct()
    hit = spans.select(*DOC, F.explode(F.expr("sequence(shift, shift + width - 1)")).alias("pos"))
    n_hit = hit.distinct().groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    items = found.groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = stored(n_hit.join(items, DOC), "index-hits")

    every = _keyed(docs).select("doc_id", *DOC, F.size("words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return every.join(per_doc, DOC, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
