"""Operators on single texts: tiling, pseudonyms, chat formats, pieces, token counts, language."""

import datetime
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grafold.llm import chat_format, decontaminate, language_id, piece_codec, pseudonyms, token_counts


def brute_tiles(a, b, least):
    least, free_a, free_b, out = max(1, min(least, len(b))), [1] * len(a), [1] * len(b), []
    while True:
        best = (0, 0, 0)
        for q in range(len(b)):
            for p in range(len(a)):
                k = 0
                while p + k < len(a) and q + k < len(b) and free_a[p + k] and free_b[q + k] and a[p + k] == b[q + k]:
                    k += 1
                if k > best[0]:
                    best = (k, q, p)
        k, q, p = best
        if k < least:
            return sorted(out)
        free_a[p : p + k] = free_b[q : q + k] = [0] * k
        out.append((p, q, k))


def test_tiles_are_greedy():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (40, 25))
        least = rng.randrange(1, 6)
        assert decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), least) == brute_tiles(a, b, least)


def test_contamination(spark):
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(10000)
    items = [[word() for _ in range(30)] for _ in range(5)] + [["tiny", "item"]]
    noise = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(8, None), (9, "")]
    moved = items[1][20:] + items[1][10:20] + items[1][:10]
    docs = [(0, noise(100)), (1, f"{noise(20)} {bench[0][1].upper()}! {noise(5)}"), (2, f"{noise(9)} {' '.join(moved)}"), (3, " ".join(items[2][:12])), (4, None), (5, ""), (6, "a tiny, item here"), (7, bench[3][1] + " " + bench[4][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contamination(df, b).collect()}
    assert set(got) == {(1, 0), (2, 1), (6, 5), (7, 3), (7, 4)}
    assert got[2, 1]["reordered"] and got[2, 1]["n_tiles"] == 3 and not got[1, 0]["reordered"]
    clean = decontaminate.clean(df, b)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [0, 3, 4, 5]
    assert decontaminate.contamination(df, b.limit(0)).count() == 0 and decontaminate.contamination(df.limit(0), b).count() == 0


def _brute_contamination(docs, items, threshold=0.5, least=5):
    split = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    out = {}
    for i, t in docs:
        for j, x in items:
            a, b = split(t), split(x)
            found = brute_tiles(a, b, least) if a and b else []
            covered = sum(f[2] for f in found)
            if found and covered >= threshold * len(b) and (len(b) >= least or covered == len(b)):
                old = out.get((i, j), (0,))
                out[i, j] = max(old, (covered, len(b), len(found), max(f[2] for f in found)))
    return out


def test_contamination_against_all_pairs(spark, monkeypatch):
    """Items of one stem, items shorter than a seed, repeated words, null ids, a long document; every pair tiled."""
    rng = random.Random(13)
    word = lambda n: "w%d" % rng.randrange(n)
    items = [(i, " ".join(["the", "stem", "that", "all", "of", "these", "begin", "with"] + [word(500) for _ in range(rng.randrange(2, 30))])) for i in range(30)]
    items += [(100 + i, " ".join(word(12) for _ in range(rng.randrange(1, 15)))) for i in range(20)] + [(200, "a a a a a a a"), (201, None), (None, "w1 w2"), (202, "a b c d e f a b c d e f")]
    items += [items[3], (300, items[3][1])]
    docs = [(i, " ".join(word(12) for _ in range(rng.randrange(0, 40)))) for i in range(25)]
    for i in range(25, 60):
        a, b = rng.choice(items[:30])[1].split(), rng.choice(items[:30])[1].split()
        at = rng.randrange(len(a))
        docs.append((i, " ".join([word(9999), *a[at:], word(9999), *b, *a[:at]][rng.randrange(6) :])))
    docs += [(60, "A, a; a a a a a a a"), (61, None), (62, ""), (None, items[4][1]), (None, items[5][1]), (63, "a b c d e f " * 3), (64, items[6][1] + " " + "filler " * 4000 + items[7][1]), (5, items[8][1])]
    want = _brute_contamination(docs, [x for x in items if None not in x])
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item int").repartition(3)
    b = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, g int").repartition(2)
    monkeypatch.setattr(decontaminate, "GROUP", 3)
    got = {tuple(r)[:2]: tuple(r)[2:6] for r in decontaminate.contamination(df, b).collect()}
    assert got == want and len(want) > 60


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1001])
def test_feistel_is_a_permutation(n):
    f = pseudonyms.Feistel(b"k", "t", n)
    image = [f.forward(x) for x in range(n)]
    assert sorted(image) == list(range(n)) and [f.backward(y) for y in image] == list(range(n))


TEXTS = ["mail a.b+c@x.example.com. twice a.b+c@x.example.com", "call +1 (017) 555-7713 or 212-555-1234", "ip 17.2.3.255", "card 4111 1111 1111 1111 and 4111111111111111, 7536784127813050", "IBAN GB82 WEST 1234 5698 7654 32 DE89370400440532013000", "ssn 078-05-1120", "on 2024-02-29, 31.12.1999", 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"']


def test_pseudonyms():
    ahead, back = pseudonyms.Pseudonymiser(b"key"), pseudonyms.Pseudonymiser(b"key", False)
    for t in TEXTS:
        new, found = ahead.text(t)
        assert new != t and sum(found.values()) >= 1 and back.text(new)[0] == t
        assert re.sub(r"[0-9]+|[A-Z]+|[a-z]+", "x", new.split("ip ")[-1]).count("x") <= len(t)
    new = ahead.text(TEXTS[3])[0]
    a, b = re.findall(r"(?:\d{4} ){3}\d{4}|\d{16}", new)[:2]
    assert a.replace(" ", "") == b and pseudonyms.luhn(b)  # equal values stay linked
    mails = re.findall(r"\S+@\S+\.com", ahead.text(TEXTS[0])[0])
    assert mails[0] == mails[1]
    for t in ["4111111111111112", "300.1.1.1", "2023-02-29", "000-12-3456", "version 1.2.3", "", None, "12345678901234567890123"]:
        assert ahead.text(t)[0] == t
    assert pseudonyms.Pseudonymiser(b"other").text(TEXTS[2])[0] != ahead.text(TEXTS[2])[0]


def _valid(kind, value):
    """Validity by rules written apart from the module's."""
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "card":
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    if kind == "iban":
        plain = value.replace(" ", "")
        rest = 0
        for c in plain[4:] + plain[:4]:
            rest = int(str(rest) + str(int(c, 36))) % 97
        return rest == 1
    if kind == "ip":
        return all(int(x) < 256 for x in value.split("."))
    if kind in ("iso", "day", "month"):
        datetime.datetime.strptime(value, {"iso": "%Y-%m-%d", "day": "%d.%m.%Y", "month": "%m/%d/%Y"}[kind])
        return True
    if kind == "ssn":
        a, b, c = value.split("-")
        return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    return True


def test_pseudonyms_of_many_values():
    """Every kind: valid, of the same format, one to one over all values drawn, and back again."""
    rng, day = random.Random(11), lambda: datetime.date(1900, 1, 1) + datetime.timedelta(days=rng.randrange(73000))
    letters = "abcdefghijklmnopqrstuvwxyz"

    def card():
        body = [rng.randrange(10) for _ in range(15)]
        return next(t for t in ("".join(map(str, [4, *body[1:], d])) for d in range(10)) if _valid("card", t))

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        return next(t for t in (f"DE{c:02d}{body}" for c in range(2, 99)) if _valid("iban", t))

    def late():
        return next(d for d in iter(day, None) if d.day > 12)

    make = {
        "email": lambda: f"{''.join(rng.choices(letters, k=6))}@{''.join(rng.choices(letters, k=5))}.org",
        "phone": lambda: rng.choice(["+44 20 %04d %04d", "(020) %03d-%04d", "+49 30 %03d %04d"]) % (rng.randrange(100, 1000), rng.randrange(1000, 10000)),
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": card,
        "iban": iban,
        "ssn": lambda: f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}",
        "iso": lambda: day().isoformat(),
        "day": lambda: day().strftime("%d.%m.%Y"),
        "month": lambda: late().strftime("%m/%d/%Y"),
        "secret": lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([32, 40, 256]))),
    }
    ahead, back = pseudonyms.Pseudonymiser(b"k2"), pseudonyms.Pseudonymiser(b"k2", False)
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[0-9]", "0", t))
    for kind, draw in make.items():
        found = {}
        for value in {draw() for _ in range(150)}:
            new, counts = ahead.text(f"see {value} there")
            got = new[4:-6]
            assert sum(counts.values()) == 1 and back.text(new)[0] == f"see {value} there", (kind, value, new)
            assert _valid(kind, got) and (kind in ("ip", "secret") or shape(got) == shape(value)) and (kind != "secret" or len(got) == len(value)), (kind, value, got)
            found[got] = value
        assert len(found) >= 140 and sum(a == b for a, b in found.items()) < 3
    for t in ("in version 1.2.3.4 of it", "13/13/2020", "+1 2", "deadbeef"):
        assert ahead.text(t)[0] == t


def test_pseudonymise_table(spark):
    rows = [(i, t, 1) for i, t in enumerate([*TEXTS, None, "", "x" * 200_000 + " 17.2.3.255"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    out = pseudonyms.pseudonymise(df, b"key")
    assert out.columns[:2] == ["doc_id", "text"] and set(out.columns[2:]) == {f"n_{k}" for k in pseudonyms.KINDS}
    got = {r["doc_id"]: r for r in out.collect()}
    want = pseudonyms.Pseudonymiser(b"key")
    assert all(got[i]["text"] == want.text(t)[0] for i, t, _ in rows)
    assert pseudonyms.pseudonymise(df.limit(0), b"key").count() == 0


def test_chat_layouts(spark):
    recs = [{"messages": [{"role": "user", "content": "hi"}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"instruction": "do", "input": "x", "output": "y"}, {"instruction": "do", "output": "y"}, {"system": "s", "prompt": "p", "response": "r"}, {"foo": 1}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "id int, j string")
    got = [r["turns"] and [tuple(t) for t in r["turns"]] for r in chat_format.canonical_json(df, "j").orderBy("id").collect()]
    assert got == [[("user", "hi")], [("user", "a"), ("assistant", "b")], [("user", "do\nx"), ("assistant", "y")], [("user", "do"), ("assistant", "y")], [("system", "s"), ("user", "p"), ("assistant", "r")], None]
    # What a record holds counts: keys of other layouts and extra keys give none, null values do not hide a key.
    odd = [{"messages": [{"from": "human", "value": "lost"}]}, {"prompt": "p", "response": "r", "context": "c"}, {"prompt": "p", "completion": None}, {"messages": []}, {"messages": [{"role": "user", "content": "a"}, {"role": "x", "content": None}]}, [], None, "{"]
    df2 = spark.createDataFrame([(i, r if r in (None, "{") else json.dumps(r)) for i, r in enumerate(odd)], "id int, j string")
    got = [r["turns"] and [tuple(t) for t in r["turns"]] for r in chat_format.canonical_json(df2, "j").orderBy("id").collect()]
    assert got == [None, None, [("user", "p"), ("assistant", None)], None, [("user", "a"), ("x", None)], None, None, None]
    table = spark.createDataFrame([("do", None, "y")], "instruction string, input string, output string")
    assert [tuple(t) for t in chat_format.canonical_turns(table).first()["turns"]] == [("user", "do"), ("assistant", "y")]
    with pytest.raises(ValueError):
        chat_format.canonical_turns(df.select("j"))


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["\\", "###", "</turn>", "### user: ", " </turn>\n", "\\b", "\\h", "\\e", "\\c", ":", "#", "<", "x", "é😀", "\n", ""]
    convs = [(i, [(rng.choice(["user", "assistant", "a:b", "", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(9)))])) for _ in range(rng.randrange(1, 6))]) for i in range(80)]
    df = spark.createDataFrame(convs, "conv_id long, turns array<struct<role:string,text:string>>")
    out = chat_format.format_turns(df)
    for r in out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect():
        want = [(a or "", b or "") for a, b in convs[r["conv_id"]][1]]
        assert [tuple(x) for x in r["t"]] == want and r["l"] == "".join(b for a, b in want if a == "assistant")


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_turns(chat_format.turns_of_rows(df))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[2]["n_turns"] == 1 and None in got
    assert chat_format.turns_of_rows(df.limit(0)).count() == 0


def test_chat_rows_are_chosen_by_fingerprint(spark):
    assert chat_format.fingerprint(["text", "role", "turn", "conv_id"]) in chat_format.ROW_LAYOUTS
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError):
        chat_format.turns_of_rows(df.drop("role"))


@pytest.fixture(scope="module")
def model():
    return piece_codec.default_model()


def test_pieces_equal_the_library(model):
    codec, sp = piece_codec.codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    texts = ["", "  ", "\n\n a", "a" * 3000, "\x00 x\x00", "▁a▁▁b ▁ ", "日本語 テスト 😀😀", "<s> </s> <unk> <0x0A>", "\t\ta\r\n  b", "²³ x². ²a", " " * 100, "é é ﻿"]
    alphabet, pieces = "aabcdethionrs   \n\t.,ABé▁日0123_-😀ß", list(codec.rank)
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert codec.encode(t) == ids and codec.decode(ids) == sp.decode(ids), t
    for ids in ([1, 2], [], [3 + 0xE9, 2], [1, 28705, 0, 5], [3 + 0xF0, 3 + 0x9F, 300]):
        assert codec.decode(ids) == sp.decode(ids)


def test_pieces_table(spark, model, odd_docs, odd_texts):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoded = piece_codec.encode(odd_docs, model)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert all(got[i] == sp.encode(t or "", add_bos=True, add_eos=True) for i, t in odd_texts)
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode(encoded, model).collect()}
    assert all(back[i] == sp.decode(got[i]) for i, _ in odd_texts)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    for r in piece_codec.encode_digests(odd_docs, model).collect():
        ids = sp.encode(odd_texts[r["doc_id"]][1] or "", add_bos=True, add_eos=True)
        assert tuple(r)[1:] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode()))
    assert piece_codec.encode_digests(odd_docs.limit(0), model).count() == 0


def test_token_counts(spark, odd_docs, odd_texts):
    count = token_counts.counter(*token_counts.default_vocabulary())
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for t in ["a" + " " * 3000 + "b  c\n\n d", "x" * 3000 + " \t" * 2500 + "y1's", " " * 5000, "<|endoftext|>", *(t for _, t in odd_texts[:60] if t)]:
        assert count(t) == len(other.encode(t, add_special_tokens=False).ids)
    n = sorted(count(t) for _, t in odd_texts)
    sums = token_counts.suffix_sums(token_counts.histogram(odd_docs, *token_counts.default_vocabulary()))
    for r in sums.collect():
        x = r["n_tokens"]
        assert tuple(r)[1:] == (n.count(x), sum(a >= x for a in n), sum(a for a in n if a >= x), sum(a <= x for a in n), sum(min(a, x) for a in n))
    report = token_counts.report(sums, [0, 10, 512], [0.0, 0.5, 1.0])
    assert report["tokens"] == sum(n) and report["truncated"] == {x: sum(min(a, x) for a in n) for x in (0, 10, 512)}
    assert report["quantiles"][0.5] == n[math.ceil(len(n) / 2) - 1] and report["quantiles"][1.0] == n[-1]
    empty = token_counts.suffix_sums(token_counts.histogram(odd_docs.limit(0), *token_counts.default_vocabulary()))
    assert empty.count() == 0 and token_counts.report(empty, [5], [0.5])["docs"] == 0
    lengths = token_counts.lengths(odd_docs, *token_counts.default_vocabulary()).collect()
    assert sorted(r["n_tokens"] for r in lengths) == n


def _language(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n)).capitalize()


def test_language_id(spark):
    rng = random.Random(1)
    tongues = {"aa": ["ka", "ro", "mi", "tel"], "bb": ["schu", "ge", "lich", "ung"], "cc": ["ão", "que", "ci", "del"]}
    rows = [(i, _language(rng, tongues[x], rng.choice([3, 10, 80])), x if i % 7 else None, 1) for i in range(600) for x in [rng.choice(list(tongues))]]
    truth = {i: next(k for k, v in tongues.items() if t.lower()[:2] in {s[:2] for s in v}) for i, t, _, _ in rows}
    odd = [(1000, None, "aa", 1), (1001, "", None, 1), (1002, "123 !!", "bb", 1), (1003, "ka ro " * 400_000, None, 1)]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, score int").repartition(3)
    model = language_id.train(df, per_lang=80)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 60 and sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language_id.accepted(df, model)
    assert kept.columns == df.columns and {1000, 1001, 1002} & {r["doc_id"] for r in kept.collect()} == set() and kept.count() > 590
    none = language_id.train(df.limit(0))
    assert none is None and {r["lang_pred"] for r in language_id.predict(df, none).collect()} == {"und"}


def test_language_scores_of_blocks_equal_whole():
    rng = random.Random(2)
    texts = [_language(rng, ["ka", "ro"], 50), _language(rng, ["schu", "ung"], 50)] * 5
    model = language_id.fit(texts, ["a", "b"] * 5)
    long = "kaRo 1 schu " * 100_000  # more than one block
    whole = np.zeros((1, 2))
    n = np.zeros(1, np.int64)
    model._add(model.weights, long, whole, n, 0, 0)
    assert np.allclose(model.score([long])[0], model.probabilities(whole, n), atol=1e-6)
    one, many = model.score([texts[0]])[0], model.score(["", texts[0], "x"])[0]
    assert np.allclose(one[0], many[1])


def test_texts_of_no_learned_language_are_rejected(spark):
    rng = random.Random(7)
    tongues = {"aa": ["ka", "ro", "mi", "tel"], "bb": ["schu", "ge", "lich", "ung"], "cc": ["que", "ci", "del", "os"]}
    rows = [(i, _language(rng, tongues[x], rng.choice([10, 40, 80])), x) for i in range(400) for x in [rng.choice(list(tongues))]]
    junk = ["".join(rng.choice("bcdfghjkpqvwxyzаж") for _ in range(rng.randrange(1, 9))) for _ in range(900)]
    odd = [(1000 + i, " ".join(junk[30 * i : 30 * i + 30]), None) for i in range(30)]  # no language at all
    odd += [(2000 + i, _language(rng, ["ный", "ого", "пре", "ста"], 30), None) for i in range(30)]  # a language without labels
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(df)
    assert model.least_known > 0.5 and model.least_score > 1 / 3
    kept = {r["doc_id"] for r in language_id.accepted(df, model).collect()}
    assert not [i for i in kept if i >= 1000] and len(kept) >= 395


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tongues = {f"l{i:03d}": ["".join(rng.choices(letters, k=3)) for _ in range(4)] for i in range(230)}
    rows = [(j * 1000 + i, _language(rng, syllables, 12), lang) for i, (lang, syllables) in enumerate(tongues.items()) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.train(df).langs) == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}


def test_training_against_a_plain_loop():
    """One weight at a time, by the published update; the temperature of least loss on the held-out rows."""
    rng = random.Random(4)
    texts = [_language(rng, s, 6) for _ in range(8) for s in (["ka", "ro"], ["schu", "ro"], ["ka", "ung"])]
    langs = ["a", "b", "c"] * 8
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    model = language_id.fit(texts, langs, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=2, seed=3)
    rows, df, seen = [], {}, {}
    for t, lang in zip(texts, langs, strict=True):
        seen[lang] = seen.get(lang, 0) + 1
        for idx, x in language_id._pieces(t):
            rows.append((dict(zip(idx.tolist(), x.tolist(), strict=True)), "abc".index(lang), seen[lang] % 5 == 1))
            if seen[lang] % 5 != 1:
                for i in idx.tolist():
                    df[i] = df.get(i, 0) + 1
    train = [i for i, r in enumerate(rows) if not r[2]]
    idf = lambda i: math.log((1 + len(train)) / (1 + df.get(i, 0))) + 1
    z, q = {}, {}

    def weight(i, c):
        zi, penalty = z.get((i, c), 0.0), 0.0 if i == "bias" else l1
        return 0.0 if abs(zi) <= penalty else -(zi - math.copysign(penalty, zi)) / ((beta + math.sqrt(q.get((i, c), 0.0))) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(2):
        for r in order.permutation(train):
            x = {i: v * idf(i) * 30 for i, v in rows[r][0].items()} | {"bias": 1.0}
            w = {(i, c): weight(i, c) for i in x for c in range(3)}
            s = [sum(x[i] * w[i, c] for i in x) for c in range(3)]
            p = [math.exp(v - max(s)) for v in s]
            for i in x:
                for c in range(3):
                    g = x[i] * (p[c] / sum(p) - (c == rows[r][1]))
                    old = q.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, c]
                    q[i, c] = old + g * g
    for i in df:
        assert np.allclose(model.weights[i], [weight(i, c) * idf(i) * 30 for c in range(3)], atol=1e-4)
    assert np.allclose(model.bias, [weight("bias", c) for c in range(3)])

    def loss(t):
        total = 0.0
        for x, y, out in rows:
            if out:
                s = [(sum(v * model.weights[i, c] for i, v in x.items()) + model.bias[c]) / t for c in range(3)]
                total += math.log(sum(map(math.exp, s))) - s[y]
        return total

    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
    assert loss(model.temperature) <= min(map(loss, grid)) + 1e-6


def test_accepted_sends_a_text_once(monkeypatch):
    """The classifier reads the text of a row within the row, as it does a column of its own."""
    import pyarrow as pa

    from grafold.llm import language_id

    model = language_id.fit(["hello world this is text"] * 10 + ["guten tag das ist ein satz"] * 10, ["en"] * 10 + ["de"] * 10)
    texts = ["hello world", None, "", "guten tag", "7"] * 3
    row = pa.StructArray.from_arrays([pa.array(range(15)), pa.array(texts)], ["doc_id", "text"])
    apart, within = pa.RecordBatch.from_arrays([row, pa.array(texts)], ["row", "text"]), pa.RecordBatch.from_arrays([row], ["row"])
    want, got = (list(language_id._predict(model, True)([b.slice(2)])) for b in (apart, within))
    assert got == want and got[0].column("row").to_pylist() == row.slice(2).to_pylist()
