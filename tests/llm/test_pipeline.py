"""The corpus pipeline against plain Python versions of its stages, document by document."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from test_text_operators import brute_components, brute_leaks, brute_lines

import corpus_pipeline
from lumenledger.llm import packing, quality
from lumenledger.llm.common import table


def planted(sf, tmp_path):
    """The test tables with 20 benchmark items, and documents that each stage must change or drop."""
    docs = pq.read_table(f"{sf}/documents.parquet")
    bench = pq.read_table(f"{sf}/benchmark.parquet").slice(0, 20)
    rows = docs.to_pylist()
    good = [r for r in rows if 60 < len((r["text"] or "").split()) < 600][:12]
    more, line = [], "This very line is in several of the documents"
    for i, r in enumerate(good):
        words = r["text"].split(" ")
        words[len(words) // 2] = f"edit{i}"
        more.append(r | {"doc_id": 10_000 + i, "text": " ".join(words)})
        more.append(r | {"doc_id": 20_000 + i, "text": f"{line}\n" + " ".join(f"{w}q{i}" for w in words)})
        more.append(r | {"doc_id": 30_000 + i, "text": " ".join(f"{w}z{i}" for w in words[:40]) + " " + bench["text"][i].as_py()})
    labels = pq.read_table(f"{sf}/labels.parquet")
    junk = [(50_000 + i, f"$$$$ #### {i * 7919} ==== %%%% {i} @@@@ " * 12) for i in range(60)]
    more += [good[0] | {"doc_id": i, "text": t} for i, t in junk]
    told = labels.to_pylist() + [{c: {"doc_id": i}.get(c, 0) for c in labels.column_names} for i, _ in junk]
    pq.write_table(pa.Table.from_pylist(told, labels.schema), tmp_path / "labels.parquet")
    pq.write_table(pa.Table.from_pylist(rows + more, docs.schema), tmp_path / "documents.parquet")
    pq.write_table(bench, tmp_path / "benchmark.parquet")
    return [(r["doc_id"], r["text"]) for r in rows + more], [tuple(r.values()) for r in bench.select(["item_id", "text"]).to_pylist()]


def test_run_is_the_plain_version(spark, sf, tmp_path):
    rows, bench = planted(sf, tmp_path)
    where = str(tmp_path)
    # the classifier's weights are the operator's own; each text is scored by itself
    net = quality.train(table(spark, where, "documents"), table(spark, where, "labels"))
    raw = [(t or "").encode() for _, t in rows]
    good = [r for r, t in zip(rows, raw) if quality.scores(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] >= 0.3]
    lines = [(i, t) for i, _, _, t in brute_lines(good)]
    component = brute_components(lines, 5)
    single = [(i, t) for i, t in lines if component[i] == i]
    leaked = {d for d, _ in brute_leaks(single, bench)}
    clean = [r for d, r in enumerate(single) if d not in leaked]
    # every stage has something to do
    assert len(rows) > len(good) == len(lines) > len(single) > len(clean) > 100 and dict(lines) != dict(good)

    tokenizer = packing.WordIds(packing.default_tokenizer()).tokenizer
    want = collections.Counter()
    for (i, _), e in zip(clean, tokenizer.encode_batch([t or "" for _, t in clean], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    got = corpus_pipeline.run(spark, where).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        ends = [0, *(offset + length for offset, length in sorted(pieces))]
        assert [offset for offset, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
