import hashlib

import pytest
import regex
from winnow.llm import frames
from winnow.llm.scan import staged

UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text), text
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text), out


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_equals_brute_force(spark, odd, size):
    rows = [(i, t) for i in range(100, 140) for t in ("a b  c\n\nd é🙂 ", "  lead and trail \t\n", "x" * 50 + " " * 50 + "é" * 40, "one", "q<P>r s", "< P> <S", "　 kept whole", "日本 語" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    if size < 64:
        docs = docs.where("length(text) < 500 or text is null")
    got = frames.transformed(frames.stored(docs, size), texts=True).collect()
    key = repr
    assert sorted(map(tuple, got), key=key) == sorted((brute(r["doc_id"], r["text"]) for r in docs.collect()), key=key)


def test_frames_are_a_seekable_store(spark, odd, empty):
    import zstandard

    kept = staged(frames.stored(odd, 1000), "frames")
    assert set(odd.columns) - {"text"} < set(kept.columns)
    texts = {(r["doc_id"], len(r["text"] or "")): r["text"] or "" for r in odd.collect()}
    seen = set()
    for r in kept.collect():
        pieces = [zstandard.ZstdDecompressor().decompress(f["data"]) for f in r["frames"]]
        text = b"".join(pieces).decode()
        assert texts[r["doc_id"], len(text)] == text
        at = ""
        for f, piece in zip(r["frames"], pieces):
            at += piece.decode()
            assert (f["chars"], f["bytes"]) == (len(at), len(piece)) and f["bytes"] <= 1003
        assert [f["units"] for f in r["frames"]] == sorted(f["units"] for f in r["frames"])
        seen.add(len(r["frames"]))
    assert max(seen) > 90 and 0 in seen
    assert frames.transformed(frames.stored(empty)).count() == 0


def test_only_cut_frames_are_opened():
    text = " ".join(f"word{i}" for i in range(5000))
    import numpy as np
    import zstandard

    data = np.frombuffer(text.encode(), dtype=np.uint8)
    ends = np.array([m.end() for m in UNIT.finditer(text)])
    cuts = frames._cuts(data, ends, 4096)
    rows, at = [], 0
    for to in cuts:
        rows.append({"units": int((ends <= to).sum()), "chars": to, "bytes": to - at, "data": zstandard.compress(text[at:to].encode())})
        at = to
    opened = []
    stored = frames.Text(rows, lambda d: opened.append(1) or zstandard.decompress(d))
    assert [stored.cut(k) for k in (0, 1, 777, 5000)] == [(0, 0), (ends[0], ends[0]), (ends[776], ends[776]), (len(text), len(text))]
    assert len(opened) == 2
