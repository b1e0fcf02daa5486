"""SentencePiece encoding with the N best segmentations, and decoding.

The lattice of a text has a node between any two characters and an arc for every vocabulary piece that fits; a character
that no piece covers is one arc of byte pieces. A path's score is the sum of its pieces' scores. Forward Viterbi gives the
best score from the start to every node. These are exact heuristics for the backward A* search: it grows paths from the
end, always the one with the best ``suffix + forward score``, so complete paths come out best first.

A node that no arc spans splits the lattice into parts that share nothing, so a text is encoded part by part (words, runs
of marks, line feeds); parts recur and are kept in a bounded memory per worker. The gap to a part's second best path is
the least slack of an arc into a node of its best path, so A* runs only on the few parts whose second path can enter the
text's N best; their lists are merged best first.

Blanks are the word-start mark, one is put in front. A mark character in the text itself is spelled in bytes, so
``decode(encode(x)) == x`` for every text. Null and empty texts have no pieces, score 0 and one segmentation. Ties go to the
longer last piece. Repeated rows are encoded alike; other columns pass. Texts are whole at any length: a long one is cut
only at blanks and line feeds.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import body

N_BEST = 4
#: Characters encoded in one go, and parts remembered per worker (in two generations).
STRIDE = 1 << 19
REMEMBERED = 250_000
#: Scores at or below this mark pieces that the vocabulary lists but segmentation never uses.
UNUSED = -1e8
#: What a byte-spelled character costs below the worst piece.
BYTE_COST = 10.0
_MARK = "▁"
_CUT = re.compile(r"[ \n]")


class Pieces:
    """A vocabulary file with its lattice operations; needs no Spark."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.scores: dict[str, tuple[float, int]] = {}
        self.spelled: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(_MARK, " ")
                self.spelled[i] = text.encode()
                if model.get_score(i) > UNUSED and not (len(text) > 1 and " " in text[1:]):
                    self.scores[text] = (float(model.get_score(i)), i)
        self.bytes_score = min(s for s, _ in self.scores.values()) - BYTE_COST
        self._trie: dict = {}
        for text, found in self.scores.items():
            node = self._trie
            for c in text:
                node = node.setdefault(c, {})
            node[0] = found
        self.known = _Known(self._best, REMEMBERED)
        self.listed: dict[int, _Known] = {}
        self._table = pa.array(self.spelled, pa.large_binary())
        # marks that follow a letter or digit in no piece: the lattice splits in front of a run of them
        before: dict[str, set[str]] = {}
        for p in self.scores:
            for a, b in zip(p, p[1:], strict=False):
                before.setdefault(b, set()).add(a)
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum() and not any(a.isascii() and a.isalnum() for a in before.get(c, ()))}
        odd = {a for c in marks for a in before.get(c, ()) if a not in marks and a != " "}
        group = "".join(map(re.escape, sorted(marks)))
        self._fine = re.compile(rf" ?[{group}]+[^ \n{group}]*| ?[^ \n{group}]+|\n| ")
        self._coarse = re.compile(r" ?[^ \n]+|\n| ")
        self._odd = re.compile("[" + "".join(map(re.escape, sorted(odd))) + "]") if odd else None

    def parts(self, text: str) -> list[str]:
        """Independent parts of a text that already starts with its blank."""
        fine = self._odd is None or not self._odd.search(text)
        return (self._fine if fine else self._coarse).findall(text)

    def _byte_arc(self, char: str) -> tuple[float, tuple[int, ...]]:
        ids = tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))
        return self.bytes_score * len(ids), ids

    def _arcs(self, part: str, i: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(end, score, ids) of the arcs that leave node i."""
        out, node = [], self._trie
        for j in range(i, len(part)):
            node = node.get(part[j])
            if node is None:
                break
            if 0 in node:
                out.append((j + 1, node[0][0], (node[0][1],)))
        if not out or out[0][0] != i + 1:
            out.append((i + 1, *self._byte_arc(part[i])))
        return out

    def _forward(self, part: str):
        """Best score, slack of the second best arc and best arc (start, id or ids) into every node."""
        n, trie = len(part), self._trie
        best, gap, last = [-np.inf] * (n + 1), [np.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, node, j, single = best[i], trie, i, False
            while j < n:
                node = node.get(part[j])
                if node is None:
                    break
                j += 1
                found = node.get(0)
                if found is not None:
                    single = single or j == i + 1
                    value = here + found[0]
                    if value > best[j]:
                        gap[j] = value - best[j]
                        best[j], last[j] = value, (i, found[1])
                    elif best[j] - value < gap[j]:
                        gap[j] = best[j] - value
            if not single:
                score, ids = self._byte_arc(part[i])
                value, j = here + score, i + 1
                if value > best[j]:
                    gap[j] = value - best[j]
                    best[j], last[j] = value, (i, ids)
                elif best[j] - value < gap[j]:
                    gap[j] = best[j] - value
        return best, gap, last

    def _best(self, part: str) -> tuple[bytes, float, float]:
        """(piece ids as 16-bit words, score, loss of the second best path)."""
        best, gap, last = self._forward(part)
        at, ids, loss = len(part), [], np.inf
        while at:
            if gap[at] < loss:
                loss = gap[at]
            at, piece = last[at]
            if type(piece) is int:
                ids.append(piece)
            else:
                ids.extend(reversed(piece))
        ids.reverse()
        return struct.pack(f"<{len(ids)}H", *ids), best[-1], loss

    def n_best(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """Backward A* over one part: (score, ids), best first. Of equal paths the one nearest to the start is grown first."""
        best, _, _ = self._forward(part)
        into: list[list] = [[] for _ in range(len(part) + 1)]
        for i in range(len(part)):
            for j, score, ids in self._arcs(part, i):
                into[j].append((i, score, ids))
        heap, out, tick = [(-best[-1], len(part), 0, 0.0, None)], [], 0
        while heap and len(out) < n:
            _, node, _, suffix, path = heapq.heappop(heap)
            if node == 0:
                ids = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((suffix, ids))
                continue
            for i, score, ids in into[node]:
                tick += 1
                heapq.heappush(heap, (-(suffix + score + best[i]), i, tick, suffix + score, (ids, path)))
        return out

    def _ways(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """(loss, ids as 16-bit words) of the N best paths of a part; the first is the remembered one, also among equals."""
        flat, score, _ = self.known[part]
        others = [(score - s, struct.pack(f"<{len(ids)}H", *ids)) for s, ids in self.n_best(part, n)]
        return [(0.0, flat), *(w for w in others if w[1] != flat)][:n]

    def _strides(self, text: str) -> Iterator[list[str]]:
        """Parts of a text that already starts with its blank, at most about STRIDE characters at a time."""
        at = 0
        while at < len(text):
            end = at + STRIDE
            if end < len(text):
                cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                further = None if cut > 0 else _CUT.search(text, end)
                end = cut if cut > 0 else further.start() if further else len(text)
            yield self.parts(text[at:end])
            at = end

    def choices(self, text: str, n: int) -> tuple[bytes, float, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """(ids of the best segmentation as 16-bit words, its score, the N best as (loss, edits of the best one), best first);
        an edit is (start, end, ids instead) in bytes."""
        if not text:
            return b"", 0.0, [(0.0, [])]
        flat, size, score, near = [], 0, 0.0, []
        for parts in self._strides(" " + text):
            ids, scores, losses = zip(*map(self.known.__getitem__, parts), strict=True)
            score += sum(scores)
            # only the N - 1 parts of least loss can leave their best path in the N best
            if n > 1:
                loss = np.array(losses)
                least = np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2]) if len(loss) >= n else np.arange(len(loss))
                least = least[np.argsort(loss[least], kind="stable")][:n - 1]
                near += [(losses[i], size + sum(map(len, ids[:i])), parts[i]) for i in least.tolist() if losses[i] < np.inf]
            flat += ids
            size += sum(map(len, ids))
        whole = b"".join(flat)
        listed = self.listed.setdefault(n, _Known(lambda part: self._ways(part, n), REMEMBERED // 8))
        choices: list[tuple[float, list[tuple[int, int, bytes]]]] = [(0.0, [])]
        for _, at, part in sorted(near, key=itemgetter(0, 1))[:n - 1]:
            first, *ways = listed[part]
            end = at + len(first[1])
            mixed = choices + [(loss + more, [*chosen, (at, end, ids)]) for loss, chosen in choices for more, ids in ways]
            choices = sorted(mixed, key=itemgetter(0))[:n]
        return whole, score, choices

    def ranked(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """(score, ids as 16-bit words) of the N best segmentations of a whole text, best first."""
        whole, score, choices = self.choices(text, n)
        out = []
        for loss, chosen in choices:
            at, bits = 0, []
            for start, end, ids in sorted(chosen):
                bits += whole[at:start], ids
                at = end
            out.append((score - loss, b"".join([*bits, whole[at:]]) if bits else whole))
        return out

    def segmentations(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a text, best first."""
        return [(score, np.frombuffer(ids, dtype="<u2").tolist()) for score, ids in self.ranked(text, n)]

    def decode(self, ids) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids])[1:].decode("utf-8", "surrogatepass")

    def same(self, one: bytes, other: bytes) -> bool:
        """Whether two stretches of ids spell the same."""
        spelled = self.spelled
        a, b = (b"".join([spelled[i] for i in memoryview(x).cast("H")]) for x in (one, other))
        return a == b

    def spell(self, texts: list[str], lists: list[int], ends: np.ndarray, flat: pa.Array) -> list[bool]:
        """Whether all id lists of a text decode to it; ``lists`` per text, ``ends`` of the lists in ``flat``."""
        got = self._table.take(flat)
        at = np.frombuffer(got.buffers()[1], dtype=np.int64, count=len(got) + 1)[np.concatenate([[0], ends])].tolist()
        data, k, out = memoryview(got.buffers()[2] or b"").cast("B"), 0, []
        for text, n in zip(texts, lists, strict=True):
            want = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            out.append(all(data[at[i]:at[i + 1]] == want for i in range(k, k + n)))
            k += n
        return out

    def encode(self, text: str) -> tuple[bytes, float, float, bool]:
        """Of a whole text: ids as 16-bit words, score, loss of the second best segmentation, whether the ids decode to it."""
        (score, ids), *more = self.ranked(text, 2)
        return ids, score, score - more[0][0] if more else np.inf, self.decode(np.frombuffer(ids, dtype="<u2")) == text


class _Known(dict):
    """Remembered parts in two generations: when the young one is full it becomes the old one."""

    def __init__(self, work, most: int) -> None:
        super().__init__()
        self._work, self._most, self._old = work, most, {}

    def __missing__(self, part: str):
        found = self._old.get(part) or self._work(part)
        if len(part) <= 64:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[part] = found
        return found


_loaded: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of at most ``most`` characters together (or one longer text)."""
    start, size, held = 0, 0, []
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if held and size + len(text) > most:
            yield start, held
            start, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def encoded(docs: DataFrame, path: str, keep: list[Column], text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """keep..., ids (best segmentation), n_pieces, score, margin to the second best (null if there is none), round_trip (all
    segmentations decode to the text), others: array of (score, edits), the second to N-th best segmentations of every text,
    best first, each as edits of the best: ``ids[start:end]`` gives way to other ids. ``n_best`` writes them out."""
    rows = docs.select(*keep, body(F.col(text_col)).alias("whole text"))
    out = T.StructType(rows.drop("whole text").schema.fields + T._parse_datatype_string(
        "ids array<int>, n_pieces long, score double, margin double, round_trip boolean, "
        "others array<struct<score:double,edits:array<struct<start:int,end:int,ids:array<int>>>>>").fields)

    def words(lists: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        ends = np.cumsum([len(x) // 2 for x in lists], dtype=np.int64)
        return pa.array(np.frombuffer(b"".join(lists), dtype="<u2"), pa.uint16()).cast(pa.int32()), ends

    def listed(values: pa.Array, ends) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for batch in batches:
            for start, texts in _chunks(batch.column(batch.num_columns - 1), STRIDE):
                found = [model.choices(t, n) for t in texts]
                best, ends = words([whole for whole, _, _ in found])
                losses = [[loss for loss, _ in more] for _, _, (_, *more) in found]
                edits = [sorted(chosen) for _, _, (_, *more) in found for _, chosen in more]
                flat = [e for chosen in edits for e in chosen]
                instead, instead_ends = words([ids for _, _, ids in flat])
                places = np.array([(a // 2, b // 2) for a, b, _ in flat], np.int32).reshape(-1, 2)
                edit = pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1]), listed(instead, instead_ends)], ["start", "end", "ids"])
                scores = pa.array([score - loss for (_, score, _), more in zip(found, losses, strict=True) for loss in more], pa.float64())
                others = pa.StructArray.from_arrays([scores, listed(edit, np.cumsum(list(map(len, edits)), dtype=np.int64))], ["score", "edits"])
                whole_back = model.spell(texts, [1] * len(texts), ends, best)
                back = [ok and all(model.same(whole[a:b], ids) for _, chosen in more for a, b, ids in chosen)
                        for ok, (whole, _, more) in zip(whole_back, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(start, len(texts)) for c in batch.columns[:-1]), listed(best, ends), pa.array(np.diff(ends, prepend=0)),
                     pa.array([score for _, score, _ in found], pa.float64()), pa.array([more[0] if more else None for more in losses], pa.float64()),
                     pa.array(back), listed(others, np.cumsum(list(map(len, losses)), dtype=np.int64))], [f.name for f in out])

    return rows.mapInArrow(run, out)


def n_best(docs: DataFrame, path: str, keep: list[Column], n: int = N_BEST, text_col: str = "text") -> DataFrame:
    """keep..., ranked: array of (score, ids), the N best segmentations of every text, best first."""
    out = encoded(docs, path, keep, text_col, n)

    def whole(edits: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))
        done = F.aggregate(edits, zero, lambda acc, e: F.struct(
            e["end"].alias("at"), F.concat(acc["ids"], F.slice("ids", acc["at"] + 1, e["start"] - acc["at"]), e["ids"]).alias("ids")))
        return F.concat(done["ids"], F.slice("ids", done["at"] + 1, F.size("ids") - done["at"]))

    first = F.array(F.struct("score", "ids"))
    ranked = F.concat(first, F.transform("others", lambda o: F.struct(o["score"].alias("score"), whole(o["edits"]).alias("ids"))))
    return out.select(*out.columns[:len(keep)], ranked.alias("ranked"))


def decoded(rows: DataFrame, path: str, keep: list[Column], ids_col: str = "ids") -> DataFrame:
    """keep..., text: the texts that id lists spell; null for a null list."""
    chosen = rows.select(*keep, F.col(ids_col).alias("piece ids"))
    out = T.StructType(chosen.drop("piece ids").schema.fields + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [f.name for f in out])

    return chosen.mapInArrow(run, out)
