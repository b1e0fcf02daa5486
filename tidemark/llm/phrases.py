"""Phrases whose words belong together: collocations of two to four words, per language, from counts of longest windows.

Top-order marginalisation. Each word of a piece opens one window: itself and the next three words (shifted columns of the
piece's words), padded at the piece's end. Only these windows are counted; one Spark ROLLUP over (lang, w1, w2, w3, w4) then
sums them to the counts of all shorter prefixes, that is of all phrases, and of all words of a language.

Exact cuts keep the windows few, as no part of a phrase is rarer than the phrase. A window ends before a word that its language
has fewer than ``least`` times, and before a word with which its beginning is met fewer than ``least`` times: tasks send sorted
windows packed, by hash range of the first two words, so that each range holds all windows of its pairs and can tell. Words
travel as numbers while the vocabulary of such frequent words is at most ``most_words``; a larger one is never gathered, and the
words travel themselves, uncut. A pair without a hot word has a bounded number of windows; those of hot pairs (and triples) are
dealt over ranges by their next word and are not cut before it.

Null texts are empty, a null language is ``und``. Repeated rows count each. Other columns are not read. Empty tables, and
languages without a frequent phrase, give no rows. All counts are over whole texts and all rows; ``top`` is the report's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.llm.common import sized, stage

#: Occurrences of a candidate; its share that a longer one must have to replace it; scale of the score; rows a language.
LEAST, COVERED_PERCENT, SCALE, TOP = 30, 80, 2_000_000, 2000
WIDTH = 4
#: Frequent words up to which they travel as numbers (some 20 bytes each, sent to every executor).
MOST_WORDS = 1_000_000
#: A word met more often is hot: more windows than one range should take.
HOT = 1 << 21
#: Distinct windows aimed at per hash range, and held by a task before it sends them.
PER_RANGE, PACKET = 1 << 21, 1 << 21
BROADCAST_PHRASES = 500_000
NO_LANGUAGE = "und"

#: Ends of pieces, and the blanks between the words of a piece.
_ENDS, _BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_LOWER = bytes(range(ord("A"), ord("Z") + 1))
_TABLE = bytes.maketrans(_LOWER + _ENDS + _BLANKS, _LOWER.lower() + b"\n" * len(_ENDS) + b" " * len(_BLANKS))
_WORDS = [f"w{i + 1}" for i in range(WIDTH)]


def piece_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, number of the piece of each); no piece spans two texts."""
    chars = np.frombuffer(b"\n".join(texts).translate(_TABLE), np.uint8)
    inside = (chars != 32) & (chars != 10)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(chars[inside])])
    return words, np.cumsum(chars == 10)[starts]


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.DictionaryArray, np.ndarray]]:
    for batch in batches:
        for part in shingles.pieces(batch, 1, 8 << 20):
            langs = np.array(part.column(0).to_pylist(), dtype=object)
            texts = part.column(1).cast(pa.binary())
            for lang in dict.fromkeys(langs):
                words, piece = piece_words(texts.filter(pa.array(langs == lang)).to_pylist())
                if len(words):
                    yield lang, words.dictionary_encode(), piece


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, words, _ in _by_lang(batches):
        n = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), words.dictionary.cast(pa.utf8()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def windows(codes: np.ndarray, piece: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct windows of codes (0: none, ends a window) and how often each occurs."""
    columns = [codes]
    for shift in range(1, WIDTH):
        ahead = np.zeros_like(codes)
        ahead[:-shift] = np.where(piece[shift:] == piece[:-shift], codes[shift:], 0)
        columns.append(np.where(columns[-1] > 0, ahead, 0))
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(codes), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(first, append=len(codes))


def _window_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the words themselves (pad: empty)."""
    for lang, words, piece in _by_lang(batches):
        columns, n = windows(words.indices.to_numpy(zero_copy_only=False) + 1, piece)
        spelled = pa.concat_arrays([pa.array([""], pa.utf8()), words.dictionary.cast(pa.utf8())])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *(spelled.take(pa.array(c)) for c in columns), pa.array(n, pa.int64())], names=["lang", *_WORDS, "c"])


def _packed(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Sorted windows and counts by planes of equal bytes, compressed."""
    first = np.diff(columns[0], prepend=np.int32(0))
    flat = np.concatenate([first.astype(np.int32), *columns[1:], n.astype(np.int32)]).view(np.uint8)
    return pa.compress(np.ascontiguousarray(flat.reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpacked(packet: bytes, rows: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packet, decompressed_size=rows * 4 * (WIDTH + 1), codec="zstd", asbytes=True), np.uint8)
    flat = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).reshape(WIDTH + 1, rows).copy()
    flat[0] = np.cumsum(flat[0])
    return flat


def _distinct(columns: np.ndarray) -> np.ndarray:
    """Equal windows (all rows but the last) put together, their counts (last row) summed; sorted."""
    columns = columns[:, np.lexsort(columns[WIDTH - 1 :: -1])]
    new = np.ones(columns.shape[1], bool)
    new[1:] = (columns[:WIDTH, 1:] != columns[:WIDTH, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    out = columns[:, first]
    out[WIDTH] = np.add.reduceat(columns[WIDTH], first) if len(first) else 0
    return out


def cut_short(columns: np.ndarray, hot: int, least: int) -> np.ndarray:
    """Distinct windows, each ended before the word with which its beginning is rare; a beginning of hot words only is spared."""
    w = _distinct(columns)
    for k in range(2, WIDTH + 1):
        if not w.shape[1]:
            break
        new = np.ones(w.shape[1], bool)
        new[1:] = (w[:k, 1:] != w[:k, :-1]).any(axis=0)
        total = np.add.reduceat(w[WIDTH], np.flatnonzero(new))[np.cumsum(new) - 1]
        # windows of a hot beginning may lie in several ranges, but for the last word
        spared = (w[:k] <= hot).all(axis=0) if k < WIDTH else np.zeros(len(total), bool)
        w[k - 1 : WIDTH, (total < least) & ~spared] = 0
    return _distinct(w)


class _Vocabulary:
    """Frequent words on the workers: language -> (words, their numbers); numbers count from 1 by falling frequency."""

    def __init__(self, frequent: DataFrame):
        rows = frequent.orderBy(F.desc("n"), "lang", "word").toArrow()
        counts = rows.column("n").to_numpy()
        self.hot, self.ranges = int((counts > HOT).sum()), 1 + int(counts.sum()) // PER_RANGE
        self.shared = frequent.sparkSession.sparkContext.broadcast((rows.column("lang").to_pylist(), rows.column("word").combine_chunks()))

    def __call__(self) -> dict:
        langs, words = self.shared.value
        langs, numbers = np.array(langs, dtype=object), np.arange(1, len(langs) + 1, dtype=np.int32)
        return {x: (words.filter(pa.array(langs == x)).cast(pa.large_utf8()), numbers[langs == x]) for x in dict.fromkeys(langs)}

    def packets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(range, rows, packet): windows of numbers by hash range; those without a first word go by language, as number -1, -2, ..."""
        vocabulary, held, size = self(), [], 0
        codes_of = {lang: i for i, lang in enumerate(vocabulary)}

        def flush() -> pa.RecordBatch:
            w = _distinct(np.concatenate(held, axis=1))
            spread = shingles.mix(w[0].astype(np.uint64) + (w[1].astype(np.uint64) << np.uint64(32)))
            for k in range(2, WIDTH):  # a beginning of hot words is dealt by its next word
                hot = ((w[:k] > 0) & (w[:k] <= self.hot)).all(axis=0)
                spread[hot] = shingles.mix(spread[hot] + w[k, hot].astype(np.uint64) + np.uint64(k))
            place = (spread % np.uint64(self.ranges)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
            parts = np.split(order, cuts[1:])
            return pa.RecordBatch.from_arrays([
                pa.array(place[order][cuts]), pa.array([len(p) for p in parts], pa.int64()),
                pa.array([_packed([w[i, p] for i in range(WIDTH)], w[WIDTH, p]) for p in parts], pa.binary())], names=["range", "rows", "packet"])

        for lang, words, piece in _by_lang(batches):
            if lang not in vocabulary:
                continue  # no word of the language can be part of a phrase
            known, numbers = vocabulary[lang]
            place = pc.index_in(words.dictionary, known).fill_null(-1).to_numpy(zero_copy_only=False)
            columns, n = windows(np.append(numbers, 0)[place].astype(np.int32)[words.indices.to_numpy(zero_copy_only=False)], piece)
            columns[0] = np.where(columns[0] > 0, columns[0], -1 - codes_of[lang]).astype(np.int32)
            held.append(np.stack([*columns, n.astype(np.int32)]))
            size += len(n)
            if size >= PACKET:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def gathered(self, least: int) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            w = np.concatenate([_unpacked(p, n) for p, n in zip(group.column("packet").to_pylist(), group.column("rows").to_pylist(), strict=True)], axis=1).astype(np.int64)
            w = cut_short(w, self.hot, least)
            langs = list(dict.fromkeys(self.shared.value[0]))
            by_word = pa.array(self.shared.value[0])
            lang = pa.concat_arrays([by_word, pa.array(langs)]).take(pa.array(np.where(w[0] > 0, w[0] - 1, len(by_word) - 1 - w[0])))
            return pa.table([lang, *(pa.array(np.maximum(w[i], 0), pa.int32()) for i in range(WIDTH)), pa.array(w[WIDTH])], names=["lang", *_WORDS, "c"])
        return run

    def spell(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = self.shared.value[1]
        for batch in batches:
            i = batch.schema.get_field_index("phrase")
            listed = batch.column(i)
            spelled = words.take(pc.subtract(listed.flatten(), 1))
            edges = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))]).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), spelled), " ")
            yield batch.set_column(i, "phrase", joined.cast(pa.utf8()))


def phrase_counts(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """((lang, phrase, f) of all phrases of one to four words met ``least`` times, and () for all words of the language;
    a function that spells the column ``phrase``)."""
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = base.mapInArrow(_word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    frequent = stage(counts.where(F.col("n") >= least), "frequent-words")
    small = frequent.limit(most_words + 1).count() <= most_words
    if small:
        vocabulary = _Vocabulary(frequent)
        packets = base.mapInArrow(vocabulary.packets, "range bigint, rows bigint, packet binary")
        counted = packets.groupBy("range").applyInArrow(vocabulary.gathered(least), f"lang string, {', '.join(f'{w} int' for w in _WORDS)}, c bigint")
        pad: Column = F.lit(0)
    else:
        counted = base.mapInArrow(_window_words, f"lang string, {', '.join(f'{w} string' for w in _WORDS)}, c bigint")
        pad = F.lit("")
    summed = counted.rollup("lang", *_WORDS).agg(F.sum("c").alias("f"), F.grouping_id().alias("level"))
    # level: a bit for each column summed over, the last one lowest
    size = F.lit(WIDTH) - F.bit_count("level").cast("int")
    named = summed.where("level < 31").select("lang", F.slice(F.array(*_WORDS), F.lit(1), size).alias("phrase"), "f")
    kept = named.where((F.size("phrase") == 0) | ((F.col("f") >= least) & (F.element_at(F.col("phrase"), -1) != pad)))
    spell = (lambda df: df.mapInArrow(vocabulary.spell, ", ".join(f"{n} string" if n == "phrase" else f"{n} {t}" for n, t in df.dtypes))) if small \
        else (lambda df: df.withColumn("phrase", F.array_join("phrase", " ")))
    return stage(kept, "phrase-counts"), spell


def _part(first: Column, n: Column) -> Column:
    return F.slice("phrase", first, n)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language by their lowest-scoring cut."""
    counts, spell = phrase_counts(docs, least, most_words)
    size = F.size("phrase")
    known = sized(counts.where(size > 0).select(F.col("lang").alias("kl"), F.col("phrase").alias("kp"), "f"), BROADCAST_PHRASES)
    cands = counts.where(size > 1).withColumnRenamed("f", "a")

    cuts = cands.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    halves = cuts.select("*", _part(F.lit(1), F.col("cut")).alias("head"), _part(F.col("cut") + 1, size - F.col("cut")).alias("tail"))
    for half, name in (("head", "l"), ("tail", "r")):
        halves = halves.join(known, (F.col("lang") == F.col("kl")) & (F.col(half) == F.col("kp"))).withColumnRenamed("f", name).drop("kl", "kp")
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = halves.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    inner = cands.where(size > 2).select("lang", "phrase", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("lang", "phrase", "a", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    longer = inner.groupBy(F.col("lang").alias("il"), _part(F.col("at"), F.col("m")).alias("ip")).agg(F.max("a").alias("longer"))
    wide = lambda c, by: F.lit(by).cast("decimal(3,0)") * F.col(c).cast("decimal(20,0)")
    covered = F.col("longer").isNotNull() & (wide("longer", 100) >= wide("a", COVERED_PERCENT))
    left = best.join(longer, (F.col("lang") == F.col("il")) & (F.col("phrase") == F.col("ip")), "left").where(~covered)

    spelled = spell(left.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").cast("long").alias("score")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    totals = counts.where(size == 0).select(F.col("lang").alias("tl"), F.col("f").alias("n"))
    ranked = spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("tl")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
