import io

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import make_docs, ready, real_docs  # noqa: F401

from attestlake.llm.token_files import (
    PieceCache,
    TokenFile,
    TokenFileWriter,
    encode_texts,
    file_starts,
    read_token_files,
    token_folder,
    write_token_files,
)

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


def whole(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return [[*e.ids, 2] for e in model.encode_batch(list(texts), add_special_tokens=False)]


TEXTS = [
    "",
    "a",
    "  two  spaces \n\n and\tlines ",
    "don't we're 'state' 'S",
    "Ünïcödé — 東京 ²³ 12,5 × ÷ ñ'll",
    "emoji 😀😀 a😀 b",
    "x" * 5000,
    "the <|endoftext|> mark",
    "   nbsp em",
    "ﬁ ŉ Ł ſ ƀ",
]


def test_pieces_give_the_tokenizers_ids():
    got = list(encode_texts(pa.array(TEXTS), PieceCache(PATH, limit=3), 2))
    assert [g.tolist() for g in got] == whole(TEXTS)


def test_random_texts_give_the_tokenizers_ids():
    rng = np.random.default_rng(1)
    alphabet = list("ab Z'st,.\n\t-10é×ñ—東😀²_ ſƀ")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(3000)]
    got = list(encode_texts(pa.array(texts), PieceCache(PATH), 2))
    assert [g.tolist() for g in got] == whole(texts)


def test_real_texts_give_the_tokenizers_ids(real_docs):
    texts = [r.text for r in real_docs.select("text").collect()]
    got = list(encode_texts(pa.array(texts), PieceCache(PATH), 2))
    assert [g.tolist() for g in got] == whole(texts)


class Counted(io.BytesIO):
    reads = 0

    def read(self, size=-1):
        self.reads += size
        return super().read(size)


def test_only_asked_frames_are_read_and_damage_is_seen():
    out = io.BytesIO()
    writer = TokenFileWriter(out, width=2, frame_ids=1000)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 1, 999, 1000, 1001, 20_000)]
    for i, ids in enumerate(docs):
        writer.add(i if i else None, ids)
    writer.close()
    data = out.getvalue()
    file = Counted(data)
    tokens = TokenFile(file, len(data))
    assert [tokens.read(i).tolist() for i in range(6)] == [d.tolist() for d in docs]
    assert tokens.nameless.tolist() == [1, 0, 0, 0, 0, 0]
    file.reads = 0
    tokens.read(2)
    assert file.reads < 2100
    import zstandard

    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    assert len(stream.read()) == 2 * sum(map(len, docs))  # plain readers skip the tables
    spoiled = bytearray(data)
    spoiled[int(tokens.starts[2]) + 20] ^= 1
    with pytest.raises(Exception, match="checksum|[Dd]ecompress|zstd"):
        TokenFile(io.BytesIO(bytes(spoiled)), len(spoiled)).read(2)
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(data[:-1]), len(data) - 1)


def test_round_trip_with_requests(ready, make_docs):
    rows = [(7, "seven"), (None, "nameless"), (3, None), (5, ""), (5, "again"), (4, "long " * 30_000)]
    index = write_token_files(make_docs(rows).repartition(4), token_folder(ready), PATH, 2, frame_ids=5000)
    files = file_starts(index)
    back = read_token_files(ready, files).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, 3, 4, 5, 5, 7]
    ids = {(d, t): i for (d, t), i in zip(rows, whole([t or "" for _, t in rows]), strict=True)}
    at = 0
    for r in back:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert got in [i for (d, _), i in ids.items() if d == r.doc_id]
        assert (r.start, r.n_tokens) == (at, len(got))
        at += len(got)
    some = read_token_files(ready, files, index.filter("doc_id = 4")).collect()
    assert [(r.doc_id, r.n_tokens) for r in some] == [(4, len(ids[(4, rows[-1][1])]))]


def test_empty_table(ready, make_docs):
    index = write_token_files(make_docs([]), token_folder(ready), PATH, 2)
    assert index.count() == 0
    assert read_token_files(ready, file_starts(index)).count() == 0


def plain(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    return [[*model.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_added_tokens_in_texts_are_those_tokens(ready, make_docs):
    rng = np.random.default_rng(5)
    parts = ["<|endoftext|>", "<|endof", "text|>", "<|", " ", "  ", "word", "Z", "é", "\n", "'s", "12"]
    texts = [*TEXTS, "<|endof", "text|><|endoftext|>", "<|endoftext|>"]
    texts += ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(2000)]
    want = plain(texts)
    got = encode_texts(pa.array(texts), PieceCache(PATH, spell_special=False), 2)
    assert [g.tolist() for g in got] == want and sum(50256 in w for w in want) > 500
    index = write_token_files(make_docs(list(enumerate(texts))).repartition(3), token_folder(ready), PATH, 2)
    back = read_token_files(ready, file_starts(index)).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in back] == want
    assert [r.start for r in back] == np.cumsum([0, *map(len, want)])[:-1].tolist()
