"""Python kernels hold a few rows as objects, however long the Arrow batch is."""

import tracemalloc

import pyarrow as pa

from tidemark.functions import chunk, stem
from tidemark.functions.slices import ROWS, mapped, slices
from tidemark.operators import safety, web


def _peak_mb(run):
    """Most MB of Python objects (Arrow buffers do not count)."""
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_slices_cover_a_batch():
    batch = pa.array([*range(150), None])
    assert [len(s) for s in slices(batch)] == [ROWS, ROWS, 151 - 2 * ROWS]
    assert mapped(batch, lambda v: v, pa.int64()).equals(batch) and len(mapped(batch[:0], str, pa.string())) == 0


def test_pages_are_held_a_few_at_a_time(spark):
    html = "<title>t{0}</title><p>" + "word " * 2000 + "</p><a href='/x{0}'>x</a>"
    rows = [(i, "http://a.org/y", html.format(i)) for i in range(500)] + [(500, "http://a.org/z", None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["page_id", "url", "html"])
    assert _peak_mb(lambda: [None for _ in web._read_pages([batch])]) < 5
    out = web.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.page_id, r.title, r.links) for r in out[:-1]] == [(i, f"t{i}", [f"http://a.org/x{i}"]) for i in range(500)]
    assert (out[-1].title, out[-1].text, out[-1].links) == ("http://a.org/z", "", [])


def test_sentences_are_held_a_few_at_a_time(spark):
    texts = [[[f"w{i}x{j}y{k}" for k in range(20)] for j in range(20)] for i in range(400)]
    texts[7].append(texts[7][3])
    batch = pa.array([*texts, None])
    del texts
    assert _peak_mb(lambda: safety._near_sentences.func(batch)) < 5
    assert safety._near_sentences.func(batch).to_pylist() == [i == 7 for i in range(401)]


def test_chunks_are_held_a_few_at_a_time():
    texts = [f"{i}. " + "some words here. " * 600 for i in range(500)]
    batch = pa.array([*texts, "", None])
    assert _peak_mb(lambda: chunk._chunks.func(batch)) < 5
    assert chunk._chunks.func(batch).to_pylist() == [*map(chunk.split_text, [t.strip() for t in texts]), [], []]


def test_stems_of_lists_make_no_lists_of_objects():
    words = [f"applying{i % 50} relational flies".split() * 100 for i in range(1500)]
    batch = pa.array([*words, None, [], ["running", None]])
    assert _peak_mb(lambda: [len(x) for x in stem._stems.func(iter([batch]))]) < 5
    assert pa.concat_arrays(stem._stems.func(iter([batch]))).to_pylist() == [[stem.stem(w) for w in ws] for ws in words] + [None, [], ["run", None]]
