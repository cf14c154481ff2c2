import hashlib
import random

import public_tokenizers as public
import pyarrow as pa
import pytest
import regex
import tiktoken

from winnow.llm import bpe_tree
from winnow.llm.bpe_tree import Coder, TreeEncoder, encode_decode, load_ranks
from winnow.llm.scan import blocks

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def test_equals_the_library_on_random_texts(library):
    tree, split, rng = TreeEncoder(load_ranks(PATH)), regex.compile(public.PATTERN), random.Random(7)
    alphabets = ["abcdefghij", "ab", "éèêabc", "  \n\t", "0123456789", "!?.-=_#", "日本語あい🙂"]
    for _ in range(500):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 8, 50, 300])))
        assert [i for m in split.findall(text) for i in tree.encode(m.encode())] == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 9000, "=" * 9000, " " * 3000 + "x", "etaoin" * 4000])
def test_long_matches(library, text):
    tree, split = TreeEncoder(load_ranks(PATH)), regex.compile(public.PATTERN)
    ids = [i for m in split.findall(text) for i in tree.encode(m.encode())]
    assert ids == library.encode_ordinary(text)
    assert tree.decode(tuple(ids)) == text.encode()


def test_joining_is_associative():
    tree = TreeEncoder(load_ranks(PATH))
    a, b, c = (tree.encode(x) for x in (b"inter", b"nation", b"alisation"))
    assert tree.join(tree.join(a, b), c) == tree.join(a, tree.join(b, c)) == tree._reduce(b"internationalisation")


def test_table(spark, odd, empty, library):
    for row in encode_decode(odd, PATH, public.PATTERN).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        text = row["text"] or ""
        assert row["ids"] == library.encode_ordinary(text)
        assert row["n_tokens"] == len(row["ids"])
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, row["ids"])).encode()).hexdigest()
    assert encode_decode(odd, PATH, public.PATTERN, ids=False).count() == odd.count()
    assert encode_decode(empty, PATH, public.PATTERN).count() == 0


def block(texts):
    (_, data, offsets), = blocks(pa.array(texts, pa.string()), limit=1 << 30)
    return texts, data, offsets


def test_small_memories_change_nothing(library, monkeypatch):
    """Generations turn over many times within a block and between blocks."""
    monkeypatch.setattr(bpe_tree, "REMEMBERED", 5)
    monkeypatch.setattr(bpe_tree, "REMEMBERED_MATCHES", 7)
    coder, rng = Coder(load_ranks(PATH), public.PATTERN), random.Random(5)
    known = ["".join(rng.choice("aeioubcdfé🙂 ") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    for _ in range(12):
        texts = [" ".join(rng.choices(known, k=rng.randrange(9))) for _ in range(20)]
        ids, bounds, decoded = coder.encode(*block(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]
        assert b"".join(decoded.to_pylist()).decode() == "".join(texts)


def test_matches_of_one_hash_are_told_apart(library, monkeypatch):
    class Same(bpe_tree.Spans):
        def hashes(self, starts, ends):
            return super().hashes(starts, ends) & 3

    monkeypatch.setattr(bpe_tree, "Spans", Same)
    coder = Coder(load_ranks(PATH), public.PATTERN)
    texts = ["many words fall on four hashes", "and are told apart", ""]
    for _ in range(2):
        ids, bounds, _ = coder.encode(*block(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]


def test_patterns_that_leave_text_out():
    coder = Coder(load_ranks(PATH), r"[a-zé]+")
    ids, bounds, decoded = coder.encode(*block(["one, twé 3 four", "12", "x"]))
    assert [b"".join(decoded.to_pylist()[a:b]).decode() for a, b in zip(bounds, bounds[1:])] == ["onetwéfour", "", "x"]
