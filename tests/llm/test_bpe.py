import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from branchstone.llm.bpe import Codec, bpe_encode, long_digests, read_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    draw = random.Random(11)
    signs = "aaabcdeEEstrn    '\n\t\r.,;!?0123456789éüñß#&|<>-_ªº²½×÷µ \u0085​ \x00\x1c\x1f漢字かな한글Ωж😀👍🏽éा١٢Ⅷ"
    out = ["", " ", "\n\n x", "I'm we're they'll don't 'tis ''s 's'", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "<|endoftext", "x" * 5000, " " * 300 + "y", "ab" * 3000, "The quick brown fox", "123456789 1234", "\r\n\r\n", "abc \n def  ghi\n"]
    out += ["".join(draw.choices(signs, k=draw.randint(1, 60))) for _ in range(1500)]
    out += ["".join(draw.choice(["th", "er", "tion", " un", "ing", "ß", "aux ", " the", "ly", "ñ", "A", "'s"]) for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    return out


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def test_long_texts_part_by_part(library, monkeypatch):
    codec = Codec(**read_vocabulary(PATH))
    for text in ["", *texts()[4:7], "The quick  brown\n fox's <|endoftext|> é漢😀 " * 60_000]:
        ids = library.encode(text, add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        assert long_digests(codec, text) == want


def test_matches_the_library(spark, library):
    rows = [(k, t) for k, t in enumerate(texts())] + [(9000, None), (9001, "twice"), (9001, "twice"), (None, "no id"), (9002, "long text 1\n" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as N_tokens", "'x' as other").repartition(4)
    got = bpe_encode(df, PATH).collect()
    assert got[0].__fields__ == ["doc_id", "other", "n_tokens", "ids", "decoded"]
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, "x", len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    digests = {r.doc_id: r for r in bpe_encode(df, PATH, carry=["doc_id"], digests=True).collect()}
    for k, _, n, ids, text in want:
        assert digests[k].n_tokens == n
        assert digests[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{n}I", *ids)).hexdigest()
        assert digests[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_words_block_by_block(library, monkeypatch):
    """Words of many blocks, with and without seams that have to be moved, against the library."""
    codec, draw = Codec(**read_vocabulary(PATH)), random.Random(6)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    words = ["".join(draw.choices(signs, k=n)) for n in (4096, 4097, 30_000)] + ["a" * 50_001, "=" * 9999, " " * 20_003, "漢字かな" * 5000, "é" * 9000, "ab" * 9001, "nationalization" * 3000]
    for block in (4096, 64, 7):
        monkeypatch.setattr("branchstone.llm.bpe.BLOCK", block)
        for word in words:
            word = word if block > 7 else word[:3000]
            if len(word.encode()) > block:
                ids = [i for x in codec.blocks(word.encode()) for i in x]
                assert ids == library.encode(word, add_special_tokens=False).ids, (word[:9], block)


@pytest.mark.parametrize("kind", ["words", "letters", "japanese"])
def test_memory_of_a_long_text(kind):
    """10 MB in a process of its own: what is held beyond the text does not grow with it."""
    import subprocess
    import sys

    code = """
import random, resource, sys
from branchstone.llm.bpe import Codec, long_digests, read_vocabulary
draw = random.Random(1)
text = {"words": "some words " * 900_000, "letters": "".join(draw.choices("abcdefgh", k=200)) * 15_000, "japanese": "漢字かな。カナ、" * 420_000}[sys.argv[1]]
codec = Codec(**read_vocabulary(sys.argv[2]))
long_digests(codec, "warm " * 1000)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
long_digests(codec, text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    said = subprocess.run([sys.executable, "-c", code, kind, PATH], capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[-1]) < 150


def test_speculation_mostly_holds():
    codec = Codec(**read_vocabulary(PATH))
    words = list({w for t in texts() for w in codec.pretokens(t)})
    assert codec.encode_words([w.encode() for w in words]) == [codec.exact(w.encode()) if w not in codec.special else codec.encode_words([w.encode()])[0] for w in words]
    assert 0 < codec.exact_words < codec.seen_words


def test_empty(spark):
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
