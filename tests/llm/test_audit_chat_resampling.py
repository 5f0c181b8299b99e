"""The filter audit, chat formatting and importance resampling against plain versions of themselves."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.llm import audit, chat, queries, resampling

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "one", "same text here", "same text here", "Ünïcode wörds 中文", "X" * 5_000, "word " * 3_000, "a#b", "\\", "<|end|>\n<|turn|>user<|says|>x", "</s>[INST] ok [/INST]"]


# --- Filter audit -------------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """The audit as it is worded: every order applied to all documents, filter by filter."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    fails = []
    for doc, text, part in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and doc > least[text]}
        fails.append((doc, part or "", own))
    out, shapley = [], Counter()
    for part in {p for _, p, _ in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[1] == part]
            for step, x in enumerate(order, 1):
                before = {id(f) for f in left}
                removed = [f for f in left if f[2][x]]
                left = [f for f in left if not f[2][x]]
                redundant = sum(f[2][x] for f in fails if f[1] == part and id(f) not in before)
                unique = sum(f[2][x] and sum(f[2].values()) == 1 for f in fails if f[1] == part)
                shapley[part, x] += len(removed)
                out.append([part, "".join(order), step, len(left), len(removed), redundant, unique, sum(f[0] in good for f in removed), sum(f[0] in toxic for f in removed)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audited(spark, rows, labels, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"mask": F.lit("x"), "n": F.lit(1.5), "part": F.lit(None).cast("int"), "id": F.lit(0)}).repartition(parts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("y"))
    return sorted(tuple(r) for r in audit.filter_audit(docs, marks).collect())


def test_audit_against_plain_filters(spark, monkeypatch):
    """Null ids, texts and parts, repeated rows, ties, copies across parts and partitions; held bytes small and large."""
    rng = random.Random(1)
    texts = ODD + ["Some words " * 120 + str(k) for k in range(4)] + [" ".join(f"w{k * 7 + j}" for j in range(220)) for k in range(6)] + ["A lot OF capitals &"]
    rows = [(rng.choice([None, k, k // 2, k % 9]), rng.choice(texts), rng.choice(["en", "de", "", None])) for k in range(160)]
    rows += rows[:20]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    wanted = plain_audit(rows, labels)
    assert audited(spark, rows, labels) == wanted
    monkeypatch.setattr(audit, "HELD_BYTES", 2_000)
    assert audited(spark, rows, labels) == wanted
    assert {r[0] for r in wanted} == {"", "de", "en"} and len(wanted) == 3 * 600


def test_audit_of_nothing_and_of_colliding_fingerprints(spark, monkeypatch):
    assert audited(spark, [], [(1, 1, 1)]) == []
    rows = [(k, f"text {k % 5}", "en") for k in range(40)]
    wanted = plain_audit(rows, [])
    got = [m for m in audit.chained(iter([((7, 1), (b"a", 0, {"x": 1})), ((7, 2), (b"b", 0, {"x": 1})), ((7, 3), (b"a", 0, {"x": 2}))]), 16)]
    assert got == [(1, "x", 0, 1), (2, "x", 0, 1), (3, "x", 16, 2)]  # one fingerprint, two texts
    assert audited(spark, rows, []) == wanted


def test_audit_sends_a_hot_text_once_a_task():
    rows = [(k, "hot", "en") for k in range(10_000, 0, -1)]
    made = list(audit.folded(iter(rows), list(audit.FILTERS.values()), 16))
    assert sum(m[0] == "text" for m in made) == 1 and sum(m[0] == "done" for m in made) == 9_999
    assert [m[1][1] for m in made if m[0] == "text"] == [1]


def test_audit_takes_other_filters(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "abc", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit.filter_audit(docs, labels, {"L": lambda words, data, chars: chars > 2}).collect()
    assert {(r.filter_order, r.step, r.kept) for r in rows} == {("LE", 1, 1), ("LE", 2, 1), ("EL", 1, 2), ("EL", 2, 1)}


# --- Chat formatting ----------------------------------------------------------------------------------------------


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def test_chat_reads_back_what_it_wrote(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3, 4]), k, rng.choice(["user", "assistant", "system", None, "<|says|>\\"]), rng.choice(ODD + ["tail <", "\\<", "[INST", "<|", "|>", "<\\|end|>", "<<SYS>>"])) for k in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "loss": F.lit("l"), "content": F.lit("c")}).repartition(5)
    segments = chat.format_turns(turns, chat.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert set(got) == {r[0] for r in rows}
    whole = {r.conv_id: r for r in chat.conversation_texts(segments).collect()}
    for conv in got:
        own = sorted(r for r in rows if r[0] == conv) if conv is not None else [r for r in rows if r[0] is None]
        r, said = got[conv], [t or "" for _, _, role, t in own if role == "assistant"]
        assert (r.n_turns, r.turns_sha256) == (len(own), digest(*[f"{role or ''}\n{t or ''}\n" for _, _, role, t in own]))
        assert (r.loss_chars, r.loss_sha256) == (sum(map(len, said)), digest(*said))
        text = whole[conv].text
        assert r.formatted_chars == len(text) and list(chat.parsed_turns(text)) == [(role or "", t or "") for _, _, role, t in own]
        assert "".join(chat.unescaped(text[s.start : s.stop]) for s in whole[conv].loss) == "".join(said)
        for control in chat.FOREIGN:
            assert control not in text
        assert text.count("<|") == 3 * len(own)


def test_chat_escapes_are_undone():
    pattern, rng = chat.control_pattern(), random.Random(3)
    for _ in range(3_000):
        text = "".join(rng.choice(["\\", "<", "|", "<|", "s>", "</s>", "[", "INST]", "<<SYS>>", "end|>", "\n", "a", "😀"]) for _ in range(rng.randint(0, 12)))
        made = chat.escaped(text, pattern)
        assert chat.unescaped(made) == text and "<|" not in made and not any(c in made for c in chat.FOREIGN)


def test_chat_typed_parts(spark):
    parts = [
        {"type": "text", "text": "see <"}, {"type": None, "text": "|end|> and"}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, {"type": "text", "text": None},
        {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "image", "ref": None}, {"type": "text", "text": "<|image|>"},
    ]
    keys = ("type", "text", "ref", "width", "height", "seconds", "pages")
    rows = [(1, 0, "assistant", [tuple(p.get(k) for k in keys) for p in parts]), (1, 1, "user", []), (1, 2, "assistant", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PARTS}")
    segments = chat.format_turns(turns, F.col("content"))
    first = segments.orderBy("turn").first()
    assert [(a.place, a.kind, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1536), (3, "image", None, 256)]
    assert first.attached_tokens == 4 + 38 + 1536 + 256
    assert first.segment == "<|turn|>assistant<|says|>see <\\|end|> and<|image|><|audio|><|document|><|image|><\\|image|><|end|>\n"
    assert [chat.unescaped(first.segment[s.start : s.stop]) for s in first.loss] == ["see <|end|> and", "<|image|>"]
    r = chat.read_back(segments).first()
    assert (r.n_turns, r.loss_sha256) == (3, digest("see <|end|> and<|image|>"))
    with pytest.raises(Exception, match="unknown content part"):
        chat.format_turns(turns, F.expr("array(named_struct('type', 'video', 'text', 'x'))")).collect()


def test_chat_long_conversations_come_in_pieces(spark):
    turns = spark.range(300).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("ab"), 50).alias("text")).repartition(7)
    segments = chat.format_turns(turns, chat.text_part(F.col("text")))
    pieces = chat.conversation_texts(segments, most_chars=1_000).orderBy("piece").collect()
    assert [p.piece for p in pieces] == list(range(len(pieces))) and len(pieces) > 20 and all(len(p.text) <= 1_000 for p in pieces)
    assert "".join(p.text[s.start : s.stop] for p in pieces for s in p.loss) == "ab" * 50 * 300
    assert chat.read_back(segments).first().formatted_chars == sum(len(p.text) for p in pieces)
    empty = turns.limit(0)
    assert chat.read_back(chat.format_turns(empty, chat.text_part(F.col("text")))).collect() == []
    assert chat.conversation_texts(chat.format_turns(empty, chat.text_part(F.col("text")))).collect() == []


# --- Importance resampling ----------------------------------------------------------------------------------------


def plain_resampling(rows, target, most_words=1, buckets=10_000, part=(10, 100), least=20):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = lambda w: [" ".join(w[k : k + n]) for n in range(1, most_words + 1) for k in range(len(w) - n + 1)]
    places = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(split(t))]
    raw, aim = Counter(b for _, t in rows for b in places(t)), Counter(b for t in target for b in places(t))
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    out = []
    for doc, text in rows:
        own = places(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(split(text))])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(eligible[: len(eligible) * part[0] // part[1]], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("most_words", "held"), [(1, 1 << 17), (1, 7), (3, 1 << 17), (3, 5)])
def test_resampling_against_plain_version(spark, monkeypatch, most_words, held):
    """Runs of several words, also across the pieces in which a text is read."""
    monkeypatch.setattr(resampling, "HELD", held)
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "null id " * 20), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("s"), "rank": F.lit(1), "__score": F.lit(2)}).repartition(4)
    features = resampling.Features(most_words=most_words)
    got = resampling.resampled(frame, target, features=features, share=(30, 100))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resampling(rows, [r.text for r in target.collect()], most_words, part=(30, 100))


def test_resampling_of_repeated_rows_and_of_nothing(spark):
    """Half of all rows are one row: as many of them are drawn as fit; ranks have no gaps."""
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text)] * 300 + [(k, text) for k in range(1000, 1300)] + [(1, "short")], "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([("w1 w2",), (None,)], "text string")
    ranks = sorted(r["rank"] for r in resampling.resampled(docs, target, share=(70, 100)).where("rank is not null").collect())
    assert ranks == list(range(1, 421))
    assert resampling.resampled(docs.limit(0), target).collect() == []
    none = resampling.resampled(docs, target.limit(0)).collect()
    assert len(none) == 601 and sum(r["rank"] is not None for r in none) == 60
    assert {r.doc_id for r in resampling.resample(docs.dropDuplicates(["doc_id"]), target, share=(1, 1)).collect()} == {5, *range(1000, 1300)}


def test_kth_key_over_the_whole_range_of_longs(spark):
    rng = random.Random(4)
    values = [(rng.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 1, rng.getrandbits(63), -rng.getrandbits(62)]), rng.randint(-3, 3)) for _ in range(500)]
    keys = spark.createDataFrame(values, "a long, b long")
    for k in (1, 2, 57, 250, 499, 500):
        assert resampling.kth_key(keys, ["a", "b"], k) == sorted(values)[k - 1]
        assert keys.where(resampling.up_to(["a", "b"], sorted(values)[k - 1])).count() >= k
    assert resampling.kth_key(keys, ["a", "b"], 501) is None and resampling.kth_key(keys, ["a", "b"], 0) is None


def test_ranks_over_many_ranges(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("x"), "id", F.lit("carried").alias("c"))
    got = resampling.ranked(rows, ["x", "id"], 1 << 24)
    wrong = got.join(rows.select("x", "id").withColumn("n", F.expr("row_number() over (order by x, id)")), ["x", "id"]).where("rank <> n")
    assert got.count() == 200_000 and wrong.count() == 0


def test_the_three_queries_run_on_every_document(spark):
    for name in ("op11_filter_audit", "op12_chat_formatting", "op13_importance_resampling"):
        df = queries.QUERIES[name](spark, SF)
        assert df.count() > 0 and name in queries.ORACLE
