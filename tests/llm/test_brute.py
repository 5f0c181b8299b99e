"""Languages and tokens against plain versions over whole texts."""

import hashlib
import re

import numpy as np
import zstandard
from pyspark.sql import functions as F

from quillstone.llm import bpe, compressid, queries

ODD = [None, "", " \n\t", "12 34 !?", "a", "É", "x" * 200_000, "word " * 60_000, "the of and die der und", "中文字" * 30_000]


def test_languages_against_plain_compression(spark):
    """Smallest code, priors, ties by name, score and margin, from their definitions, with a third of the rows alike."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = compressid.train(docs)
    texts = ODD + ["la de los que el"] * 60 + [r.text for r in docs.select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"nearest": F.lit("x"), "score": F.lit(1), "lang": F.lit(None).cast("string")})
    got = {r.doc_id: r for r in compressid.identify_language(rows, model).collect()}
    tools = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for c in model.contents]
    for k, text in enumerate(texts):
        if text is None or not any(c.isalpha() for c in text):
            assert (got[k].nearest, got[k].language, got[k].score) == ("und", "und", 0.0)
            continue
        data = re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode()
        bits = [prior + 8 * sum(len(t.compress(data[a : a + model.chunk])) for a in range(0, len(data), model.chunk)) for t, prior in zip(tools, model.prior_bits)]
        best, second = sorted(zip(bits, model.languages))[:2]
        assert got[k].nearest == best[1] and abs(got[k].margin - (second[0] - best[0]) / second[0]) < 1e-12
        assert got[k].language == (best[1] if got[k].margin >= 0.02 else "und")
        assert abs(got[k].score - 1 / sum(2.0 ** max(-1000.0, (best[0] - b) / 8) for b in bits)) < 1e-9


def test_many_languages_are_learned(spark):
    """More languages than any fixed list: each one's own texts are told apart."""
    rows = [(k, " ".join(f"{chr(97 + (k % 300) // 26 % 26)}{chr(97 + k % 300 % 26)}w{chr(97 + j)}" for j in range(20)), f"l{k % 300:03}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = compressid.train(docs)
    assert len(model.languages) == 300
    found = compressid.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("nearest = lang").count() >= 0.9 * 1200


def test_readable_text_through_the_byte_machine(spark):
    """The machine's text, fed id by id or all at once, and its digest, are the tokens' bytes read as UTF-8."""
    path = queries.vocabulary()
    tok = bpe.tokenizer(path)
    texts = ODD + ["Hello wörld, 中文! <|endoftext|> é😀", "😀" * 50_000, "ab" * 150_000, "a<b <|endoftext|>" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text_sha256", F.lit("x"))
    for r in bpe.bpe_encode(rows, path).collect():
        whole = b"".join(tok.bytes[k] for k in r.ids).decode("utf-8", "replace")
        machine = bpe.TextMachine(tok)
        assert "".join([machine.feed([k]) for k in r.ids]) + machine.end() == whole == tok.text(r.ids)
        assert r.text_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_tokens_of_long_segments_and_added_tokens():
    from tokenizers import Tokenizer

    library, tok = Tokenizer.from_file(queries.vocabulary()), bpe.tokenizer(queries.vocabulary())
    for text in ("中文字" * 60_000, "a!" * 120_000, "x<y" * 50_000 + "<|endoftext|>", ("é" * 70_000 + " ") * 3):
        assert tok.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_shards_alike_with_few_groups_loaded_and_with_many_blocks(spark, monkeypatch):
    """The paths that large tables take, forced on a small one: finer blocks, and groups loaded block by block."""
    import random

    from quillstone.llm import sharding

    rng = random.Random(6)
    texts = [rng.choice(["", "y" * rng.randint(0, 90)]) for _ in range(120)] + ["big" * 400] + [None] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shown = lambda: sorted((r.doc_id, r["size"], r.shard) for r in sharding.minimax_shards(rows, 4).collect())
    wanted = shown()
    monkeypatch.setattr(sharding, "MOST_LOADED", 0)
    assert shown() == wanted
    monkeypatch.setattr(sharding, "MANY_ROWS", 1)
    assert [x[:2] for x in shown()] == [x[:2] for x in wanted]


def test_a_page_and_a_url_of_any_length(spark):
    from quillstone.llm import tagpath, urlmodel

    text = "word, " * 200_000
    page = f"<html><body><nav><a>x</a></nav><article><p>{text}</p></article></body></html>"
    rows = spark.createDataFrame([(1, "https://a.example.org/" + "x" * 300_000, page), (2, "https://a.example.org/", "<p>" * 50_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in tagpath.extract_main_text(rows).collect()}
    assert got[1].text == text.strip() and got[2].text == ""
    assert {r.page_id: len(r.path) for r in urlmodel.filter_urls(rows, queries.URL_RULES).collect()} == {1: 300_001, 2: 1}
