"""Work that encoding and decoding do once for each word or nonterminal."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from evidenceframe.llm import token_files
from evidenceframe.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plain_words_are_cut_without_a_loop():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = ["it 'tis don't, we'LL've x's's ''s 's'tre 12a3.4 #a#9 ½²x ªº ÀÿĀ ıƏɏ ¡¿«» a_b ~|}", "so Ünïcode,wörds... it's ok§ 're 'd' d'd 'v 'l 'll", "x"]
    e = Encoder(PATH)
    e.parts.find([x.split(" ")[0].encode() for x in texts], len(texts))
    e._learn(e.parts.new)
    e.pattern = None  # what is left has no use for it
    ids, lens = e.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens))[: len(texts)]] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_nonterminals_are_expanded_once(monkeypatch):
    rng = np.random.default_rng(4)
    words = [rng.integers(1, 90, 6) for _ in range(50)]
    ids = np.append(np.concatenate([words[k] for k in rng.integers(0, 50, 5000)]), 0).astype(np.uint32)
    seen, expand = [], token_files.Shard._expand
    monkeypatch.setattr(token_files.Shard, "_expand", lambda self, seq: seen.append(len(seq)) or expand(self, seq))
    shard = token_files.Shard(token_files.pack_shard(ids, np.array([len(ids)]), 0, 100))
    assert (shard.all() == ids).all() and seen == [len(shard.rules)] and len(shard.rules) < len(shard.seq)


def test_nonterminals_longer_than_the_ids_in_all():
    ids = np.append(np.tile(np.random.default_rng(5).integers(1, 60_000, 3000), 4), 0).astype(np.uint32)
    shard = token_files.Shard(token_files.pack_shard(ids, np.array([len(ids)]), 0, 60_000))
    assert shard.lengths.sum() > 2 * len(ids) and (shard.all() == ids).all()


class Counted:
    """A model that counts the pre-tokens it is given."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, piece):
        self.calls += 1
        return self.model.tokenize(piece)


def test_a_full_store_keeps_what_stands_in_the_texts():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    e = Encoder(PATH, limit=50)
    e.model = Counted(e.model)
    texts = [" ".join(f"x{chr(97 + a)}{chr(97 + b)}q,\n{chr(98 + b)}z é" for b in range(12)) for a in range(12)]
    for _ in range(3):
        ids, lens = e.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens))[:-1]] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        first, e.model.calls = e.model.calls, 0
    assert first == 0 and len(e.pieces) > 100


def test_parts_with_line_feeds_are_cut_without_a_loop():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = ["a end.\nNext one\n two\n's 're\n x,\nÜber'll\n12\n#\n", "a b\n\nc d\n\n e\n\t f\r\n g"]
    e = Encoder(PATH)
    e.encode(pa.array(["a"], pa.string()))
    e.pattern = None
    ids, lens = e.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens))[:2]] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_shard_ends_with_the_document_that_fills_it(spark, tmp_path):
    docs = spark.createDataFrame([(k, "a b c " * 100) for k in range(7)], "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path / "t"), PATH, shard_tokens=600)
    rows = spark.read.parquet(str(tmp_path / "t")).orderBy("part", "shard").collect()
    assert [r.n_docs for r in rows] == [2, 2, 2, 1] and [x for r in rows for x in r.doc_ids] == list(range(7))
    assert [r.start for r in token_files.read_token_digests(spark, str(tmp_path / "t")).orderBy("id").collect()] == [rows[0].n_tokens // 2 * k for k in range(7)]
