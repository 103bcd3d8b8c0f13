"""Which dictionary phrases occur verbatim in which texts.

One native plan for a dictionary of any size; every phrase has an anchor that its texts must hold too.

* In a large dictionary, a phrase with enough characters after one of its spaces is anchored by what begins there: the
  longest of a few lengths, the run that the fewest other phrases hold. Texts are looked at where their words begin.
* Of the others, a phrase with a whole word between two of its spaces is anchored by such a word: the one that the
  texts hold least often, times the phrases that share it. Texts are looked at word by word.
* Any other phrase, and one whose anchor too many phrases share, is anchored by a run of its characters, the
  one that the fewest other phrases hold. Texts are looked at character by character, if there are such
  phrases at all. A few such phrases need no anchor: one regular expression finds them all, which costs less.

Words or runs of a text are first looked up in a bit set of the anchors, whose size follows the dictionary.
What is left is joined to the dictionary on the anchor, and takes along a slice of the text around it, about as
long as the longest phrase on either side; no text is shuffled whole. The join's hot anchors are split by
their measured size at run time (``spark.sql.adaptive.skewJoin``).

Equal phrases are one until the end: what is matched and shuffled are texts and different phrases, and only the
last step, which shuffles nothing any more, gives a row to each of the copies. Before it, blocks of a phrase's texts
meet blocks of its copies, and the pairs are dealt out by the rows they become: a phrase that many texts hold and
many copies have is as many tasks as it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.operators.ordering import dense_order_ids
from sigmill.session import cut

# Anchor lengths; a phrase takes the longest that it holds.
ANCHOR_LENGTHS = (1, 2, 4, 8, 16)
# 64-bit words of the anchors' bit set, at least and at most; between these, 16 bits for each anchor.
BIT_WORDS = (1 << 10, 1 << 20)
WINDOW_CHARS = 64
# Longer texts are looked at in pieces of this many characters, or of the longest phrase's if that is more.
PIECE_CHARS = 16_384
# Lengths of anchors that begin with a word; a phrase takes the longest that it holds.
START_LENGTHS = (16, 24, 32, 64)
# Texts are looked at for those in pieces of this many characters: finding a word's place costs the characters before it.
START_CHARS = 2048
# More phrases are anchored where words begin. Fewer meet each word of a text too seldom for that to pay.
MANY = 4096
# Phrases that may share an anchor.
SHARED = 256
# Phrases without an anchor word that one regular expression looks for; where there are more, their runs are looked up.
FEW = 256
# Texts and copies of a phrase in one block. The copies are a multiple of eight: rows with them repeat at whole bytes
# when they are written, which is what compresses them.
BLOCK_TEXTS, BLOCK_COPIES = 1024, 1024
# Rows of the result that one task makes, about.
TASK_ROWS = 1 << 24


def _pieces(texts: DataFrame, longest: int, chars: int) -> DataFrame:
    """``id, piece``: pieces of each text that overlap, so that whatever is at most ``longest`` long is whole in one."""
    size = max(chars, longest)
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(size))
    over = F.transform(starts, lambda at: F.substr(F.col("text"), at, F.lit(size + longest - 1)))
    return texts.select("id", F.explode(F.when(F.length("text") <= size, F.array("text")).otherwise(over)).alias("piece"))


def _anchors(phrases: DataFrame) -> DataFrame:
    """``pos, phrase, n, anchor, offset``: each phrase's rarest run, the first of equals."""
    size = F.length("phrase")
    n = F.lit(ANCHOR_LENGTHS[0])
    for length in ANCHOR_LENGTHS[1:]:
        n = F.when(size >= length, F.lit(length)).otherwise(n)
    runs = phrases.withColumn("n", n).select(
        "pos", "phrase", "n", F.explode(F.sequence(F.lit(0), size - F.col("n"))).alias("offset")
    )
    runs = runs.withColumn("anchor", F.xxhash64(F.substr("phrase", F.col("offset") + 1, F.col("n"))))
    held = runs.groupBy("n", "anchor").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("pos", "phrase").orderBy("held", "offset")
    best = runs.join(held, ["n", "anchor"]).withColumn("rank", F.row_number().over(order))
    return best.filter("rank = 1").select("pos", "phrase", "n", "anchor", "offset")


def _bit_set(anchors: DataFrame, size: int, shifts: tuple[int, ...] = (0,)) -> Column:
    """The anchors as an array of ``size`` numbers, with a bit of each anchor for each of ``shifts``."""
    shifted = anchors.select(F.explode(F.array(*[F.shiftright("anchor", by) for by in shifts])).alias("anchor"))
    bits = shifted.select(
        F.pmod("anchor", F.lit(size)).alias("word"),
        F.expr("shiftleft(1L, CAST(pmod(shiftright(anchor, 20), 64) AS INT))").alias("bits"),
    )
    every = anchors.sparkSession.range(0, size, 1, 1).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    whole = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
    return whole.select(F.transform("all", lambda x: x["bits"])).scalar()


def _bit_words(n: int) -> int:
    return min(BIT_WORDS[1], max(BIT_WORDS[0], 1 << (max(n, 1) // 4).bit_length()))


def _marked(anchor: Column, bits: Column, size: int, shifts: tuple[int, ...] = (0,)) -> Column:
    """Whether the bit set may hold ``anchor``."""

    def held(anchor: Column) -> Column:
        bit = F.pmod(F.shiftright(anchor, 20), F.lit(64)).cast("int")
        return F.getbit(F.get(bits, F.pmod(anchor, F.lit(size)).cast("int")), bit) == 1

    return reduce(Column.__and__, [held(F.shiftright(anchor, by)) for by in shifts])


def _starts(column: str, n: int) -> Column:
    """The ``n`` characters after each space that has as many after it."""
    return F.regexp_extract_all(column, F.lit(f"(?s) (?=(.{{{n}}}))"), F.lit(1))


def _start_anchors(phrases: DataFrame) -> DataFrame:
    """``pos, phrase, n, anchor, before, shared``: each phrase's run after a space, null where it has none."""
    left = F.length("phrase") - F.instr("phrase", " ")
    n, runs = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    for length in START_LENGTHS:
        fits = (F.instr("phrase", " ") > 0) & (left >= length)
        n, runs = F.when(fits, F.lit(length)).otherwise(n), F.when(fits, _starts("phrase", length)).otherwise(runs)
    each = phrases.select("pos", "phrase", n.alias("n"), F.posexplode_outer(runs).alias("i", "run"))
    # Characters before the run; the i-th run follows the i-th space.
    before = F.expr("length(substring_index(phrase, ' ', i + 1)) + 1")
    each = each.select("pos", "phrase", "n", F.when(F.col("run").isNotNull(), F.xxhash64("run")).alias("anchor"), before.alias("before"))
    held = each.groupBy("n", "anchor").agg(F.countDistinct("pos").alias("shared"))
    order = Window.partitionBy("pos", "phrase").orderBy("shared", "before")
    best = each.join(held, ["n", "anchor"], "left").withColumn("rank", F.row_number().over(order))
    return best.filter("rank = 1").select("pos", "phrase", "n", "anchor", "before", "shared")


def _by_start(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    rest = F.length("phrase") - F.col("before")
    # A row for each anchor length.
    used = dictionary.groupBy("n").agg(F.count(F.lit(1)).alias("held"), F.max("before").alias("before"), F.max(rest).alias("after")).collect()
    # Two bits of about forty: nearly all that a text holds is in no phrase.
    size, shifts = _bit_words(2 * sum(r["held"] for r in used)), (0, 26)
    bits, likely = _bit_set(dictionary.select("anchor"), size, shifts), None
    for n, _, before, after in sorted(used):
        # Pieces of pieces: cutting one out costs the characters before it.
        long = _pieces(texts, before + after, PIECE_CHARS).withColumnRenamed("piece", "text")
        each = _pieces(long, before + after, START_CHARS).select("id", "piece", F.posexplode(_starts("piece", n)).alias("i", "run"))
        kept = each.select("id", "piece", "i", F.xxhash64("run").alias("anchor")).filter(_marked(F.col("anchor"), bits, size, shifts))
        ahead = F.expr("length(substring_index(piece, ' ', i + 1)) + 1")
        begin = F.greatest(ahead - before, F.lit(0))
        part = F.substr("piece", begin + 1, ahead - begin + after)
        kept = kept.select("id", F.lit(n).alias("n"), "anchor", part.alias("part"))
        likely = kept if likely is None else likely.unionByName(kept)
    found = likely.join(dictionary.select("n", "anchor", "pos", "phrase"), ["n", "anchor"])
    return found.filter(F.contains("part", F.col("phrase"))).select("id", "pos")


def _inner_words(column: str) -> Column:
    words = F.split(column, " ")
    return F.filter(F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))), lambda w: w != "")


def _word_anchors(pieces: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """``pos, phrase, word, before, after, shared``: each phrase's anchor word, null where it has none.

    ``before`` and ``after`` count the phrase's words around the anchor. A phrase with a word that no text
    holds is in none and is left out.
    """
    size = _bit_words(n)
    bits = _bit_set(words.filter("word IS NOT NULL").select(F.xxhash64("word").alias("anchor")), size)
    each = pieces.select(F.explode(F.split("piece", " ")).alias("word")).filter(_marked(F.xxhash64("word"), bits, size))
    met = each.groupBy("word").agg(F.count(F.lit(1)).alias("met"))
    shared = words.groupBy("word").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("pos", "phrase").orderBy("cost", "word")
    ranked = words.join(shared, "word", "left").join(met, "word", "left").withColumn("cost", F.col("shared") * F.coalesce("met", F.lit(0)))
    best = ranked.withColumn("rank", F.row_number().over(order)).filter("rank = 1 AND (word IS NULL OR cost > 0)")
    all_words = F.split("phrase", " ")
    # The place of the anchor among the inner words; the first word is none of them.
    at = F.array_position(F.slice(all_words, 2, F.greatest(F.size(all_words) - 2, F.lit(0))), F.col("word")).cast("int")
    return best.select("pos", "phrase", "word", at.alias("before"), (F.size(all_words) - 1 - at).alias("after"), "shared")


def _by_word(pieces: DataFrame, dictionary: DataFrame, n: int, before: int, after: int) -> DataFrame:
    size = _bit_words(n)
    bits = _bit_set(dictionary.select(F.xxhash64("word").alias("anchor")), size)
    each = pieces.select("id", F.split("piece", " ").alias("words")).select("id", "words", F.posexplode("words").alias("i", "word"))
    first = F.greatest(F.col("i") - before, F.lit(0))
    likely = each.filter(_marked(F.xxhash64("word"), bits, size)).select(
        "id", "word", F.array_join(F.slice("words", first + 1, F.col("i") - first + after + 1), " ").alias("part")
    )
    return likely.join(dictionary.select("pos", "phrase", "word"), "word").filter(F.contains("part", F.col("phrase"))).select("id", "pos")


def _by_run(pieces: DataFrame, phrases: DataFrame) -> DataFrame:
    dictionary = cut(_anchors(phrases), "anchors")
    rest = F.length("phrase") - F.col("offset")
    # A row for each anchor length.
    used = dictionary.groupBy("n").agg(F.count(F.lit(1)).alias("held"), F.max("offset").alias("before"), F.max(rest).alias("after")).collect()
    size = _bit_words(sum(r["held"] for r in used))
    bits, likely = _bit_set(dictionary.select("anchor"), size), None
    for n, _, before, after in sorted(used):
        # Positions within short windows: finding one costs the characters before it.
        window = max(WINDOW_CHARS, before + after)
        starts = F.sequence(F.lit(0), F.length("piece") - n, F.lit(window))
        parts = pieces.filter(F.length("piece") >= n).select("id", "piece", F.explode(starts).alias("start"))
        left = F.least(F.col("start"), F.lit(before))
        # Of the piece only the window and what a phrase may need on either side.
        parts = parts.select("id", left.alias("left"), F.substr("piece", F.col("start") + 1 - left, left + F.lit(window - 1 + after)).alias("part"))
        last = F.least(F.lit(window), F.length("part") - F.col("left") - (n - 1))
        runs = parts.select("*", F.explode(F.sequence(F.lit(1), last)).alias("k")).select(
            "id", "part", (F.col("left") + F.col("k")).alias("at"), F.lit(n).alias("n"),
            F.xxhash64(F.substr("part", F.col("left") + F.col("k"), F.lit(n))).alias("anchor"),
        )
        kept = runs.filter(_marked(F.col("anchor"), bits, size))
        likely = kept if likely is None else likely.unionByName(kept)
    begin = F.col("at") - F.col("offset")
    found = likely.join(dictionary, ["n", "anchor"]).filter(
        (begin >= 1) & (F.substr("part", begin, F.length("phrase")) == F.col("phrase"))
    )
    return found.select("id", "pos")


def _by_scan(pieces: DataFrame, phrases: DataFrame) -> DataFrame:
    """The pieces in one pass: where a phrase begins, the longest that does so stands for all that it begins with."""
    few = phrases.collect()  # ``FEW`` at most

    def literal(text: str) -> str:
        return "".join(c if c.isalnum() else "\\" + c for c in text)

    by_first: dict[str, list[str]] = {}
    for phrase in sorted((r["phrase"] for r in few), key=lambda p: (-len(p), p)):
        by_first.setdefault(phrase[0], []).append(literal(phrase[1:]))
    firsts = "".join(map(literal, by_first))
    pattern = f"(?=[{firsts}])(?=(" + "|".join(f"{literal(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + "))"
    begun = [(whole["phrase"], r["pos"]) for whole in few for r in few if whole["phrase"].startswith(r["phrase"])]
    wholes = pieces.sparkSession.createDataFrame(begun, "whole string, pos bigint")
    each = pieces.select("id", F.explode(F.array_distinct(F.regexp_extract_all("piece", F.lit(pattern), 1))).alias("whole"))
    return each.join(F.broadcast(wholes), "whole").select("id", "pos")


def contained_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(id, pos)`` for every phrase that occurs in a text, compared verbatim.

    ``texts`` holds ``id, text`` (unique ids), ``phrases`` holds ``pos, phrase`` (unique ``pos``, the
    dictionary order). Empty phrases and NULL texts match nothing.
    """
    usable = phrases.filter("phrase <> ''").select(F.col("pos").cast("bigint").alias("pos"), "phrase")
    usable = cut(usable, "phrases")
    copies = cut(usable.groupBy("phrase").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies")), "different")
    found = _contained(texts, copies.select("pos", "phrase"))
    several = copies.filter("copies > 1")
    if several.isEmpty():
        return found
    return _expanded(found, usable.withColumnRenamed("pos", "copy").join(several, "phrase").select("pos", "copy"))


def _expanded(found: DataFrame, copies: DataFrame) -> DataFrame:
    """``found`` with every ``copy`` of a ``pos`` in its place, where ``copies`` has it.

    A pair of a block of texts and a block of copies of one phrase is one join key, whose rows are bounded.
    """
    found = cut(found, "found")
    numbered = dense_order_ids(copies, ["pos", "copy"], "seq").withColumn("part", F.floor(F.col("seq") / BLOCK_COPIES))
    n_copies = numbered.groupBy("pos").agg(F.count(F.lit(1)).alias("copies"), F.min("part").alias("first"), F.max("part").alias("last"))
    held = cut(found.groupBy("pos").agg(F.count(F.lit(1)).alias("held")).join(n_copies, "pos"), "held")
    rows = found.count() + (held.agg(F.sum(F.expr("held * (copies - 1)"))).first()[0] or 0)
    tasks, keys = 1 + rows // TASK_ROWS, ["pos", "part", "block"]
    n_blocks = F.ceil(F.col("held") / BLOCK_TEXTS)
    block = F.coalesce(F.pmod(F.xxhash64("id"), n_blocks), F.lit(0).cast("bigint"))
    # A NULL id stays, as it would not in a list of plain ids.
    ids = found.join(held, "pos", "left").select("pos", block.alias("block"), "first", "last", F.struct("id").alias("id"))
    ids = ids.groupBy("pos", "block", "first", "last").agg(F.collect_list("id").alias("ids"))
    ids = ids.select("pos", F.explode_outer(F.sequence("first", "last")).alias("part"), "block", "ids")
    members = numbered.groupBy("pos", "part").agg(F.collect_list("copy").alias("members")).join(held, "pos")
    members = members.select("pos", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)).alias("block"), "members")
    texts = ids.repartition(tasks, *keys).select(*keys, F.inline("ids").alias("id"))
    pairs = texts.join(members.repartition(tasks, *keys).hint("merge"), keys, "left")
    return pairs.select("id", F.explode(F.coalesce("members", F.array("pos"))).alias("pos"))


def _contained(texts: DataFrame, usable: DataFrame) -> DataFrame:
    """``contained_phrases`` for different phrases, none of them empty."""
    bodies = texts.filter("text <> ''").select("id", "text")
    parts, rest = [], usable
    if usable.count() > MANY:
        started = cut(_start_anchors(usable), "starts")
        by_start = F.col("anchor").isNotNull() & (F.col("shared") <= SHARED)
        rest = started.filter(~by_start)
        if not started.filter(by_start).isEmpty():
            parts.append(_by_start(bodies, started.filter(by_start)))
    parts += _by_parts(bodies, rest)
    if not parts:
        return texts.select("id", F.lit(0).cast("bigint").alias("pos")).limit(0)
    return reduce(DataFrame.unionByName, parts).distinct()


def _by_parts(bodies: DataFrame, usable: DataFrame) -> list[DataFrame]:
    """Matches of phrases that no run after a space finds."""
    words = cut(usable.select("pos", "phrase", F.explode_outer(_inner_words("phrase")).alias("word")), "words")
    n, longest = words.agg(F.count("word"), F.max(F.length("phrase"))).first()
    if longest is None:
        return []
    pieces = _pieces(bodies, longest, PIECE_CHARS)
    dictionary = cut(_word_anchors(pieces, words, n), "dictionary")
    by_word = F.col("word").isNotNull() & (F.col("shared") <= SHARED)
    n, before, after, runs = dictionary.agg(
        F.count_if(by_word), F.max(F.when(by_word, F.col("before"))), F.max(F.when(by_word, F.col("after"))), F.count_if(~by_word)
    ).first()
    parts = []
    if n:
        parts.append(_by_word(pieces, dictionary.filter(by_word), n, before, after))
    if runs:
        find = _by_scan if runs <= FEW else _by_run
        parts.append(find(pieces, dictionary.filter(~by_word).select("pos", "phrase")))
    return parts


def first_matches(matches: DataFrame, limit: int = 3) -> DataFrame:
    """The first ``limit`` matches of each text in dictionary order."""
    # The optimizer turns a rank filter into a per-task top-k before the shuffle.
    order = Window.partitionBy("id").orderBy("pos")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
