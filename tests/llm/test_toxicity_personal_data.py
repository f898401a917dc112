"""Toxicity and personal data: decoding, held-out quality, and base spans against brute force."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from reviewloom.llm import personal_data as P  # noqa: E402
from reviewloom.llm import toxicity as X  # noqa: E402


def restorer(texts):
    grams = pd.concat(X.count_trigrams([pd.DataFrame({"text": texts})]))
    counts = np.zeros(X.SYMBOLS**3, dtype=np.int64)
    counts[grams["gram"]] = grams["n"]
    return X.Restorer(X.CharacterModel.of(counts))


def test_only_few_places_are_tried_and_no_match_is_missed(monkeypatch):
    draw = np.random.default_rng(5)
    tried = lambda text: list(X.places(text))
    assert tried("plain words, as most texts have them, are passed over. " * 50) == []
    for alphabet in ("ab1!$ .-", "aаеb @|+\n\t.*~_", "xéßøɏªµ0 9_-.", "abc  ..1", "aab  e.e-"):
        for size in (X.PIECE, 8):
            monkeypatch.setattr(X, "PIECE", size)
            for _ in range(200):
                text = "".join(draw.choice(list(alphabet), draw.integers(0, 60)))
                starts = [at for at in range(len(text)) if X.DISGUISED.match(text, at)]
                assert set(starts) <= set(tried(text)) and tried(text) == sorted(tried(text))
                assert X.repeats(text) == bool(X.REPEATED.search(text))


def test_trigrams_count_words_with_boundaries():
    got = pd.concat(X.count_trigrams([pd.DataFrame({"text": ["ab", "AB c"]})])).set_index("gram")["n"].to_dict()
    def key(a, b, c):
        return (a * X.SYMBOLS + b) * X.SYMBOLS + c

    assert got == {key(0, 0, 1): 2, key(0, 1, 2): 2, key(1, 2, 0): 2, key(0, 0, 3): 1, key(0, 3, 0): 1}


def test_disguised_words_are_restored():
    fix = restorer(["the idiot and the clown are a stupid loser scum worthless moron"] * 50)
    cases = {"an 1d10t": "an idiot", "i d i o t here": "idiot here", "l-o-s-e-r": "loser", "cl0wn.": "clown", "idiiiot": "idiot", "w0rthle55": "worthless", "$tup1d": "stupid"}
    for given, want in cases.items():
        assert fix.text(given) == want
    for same in ("plain words stay", "a b test", "9 lives", "xy" * 100 + "1" + "yz" * 100, ""):
        assert fix.text(same) == same


def test_padding_does_not_beat_the_decoder():
    """Letters apart at any length, long repeats, look-alike letters of other scripts."""
    fix = restorer(["you are an idiot stupid loser and this is what he said to the clown with it"] * 200)
    cases = {
        "y o u a r e a n i d i o t s t u p i d": "you are an idiot stupid", "idio" + "o" * 40 + "t": "idiot", "s t u p i d l o s e r": "stupid loser", "s-t-u-p-i-d-l-o-s-e-r": "stupid loser",
        "an \u0456diot": "an idiot", "st\u03c5pid": "stupid", "привет мир": "привет мир",
    }
    for given, want in cases.items():
        assert fix.text(given) == want
    long = fix.text(" ".join("youareanidiot" * 40))
    assert long.split().count("idiot") >= 36 and long.split().count("are") >= 36


def test_decoding_finds_the_cheapest_path_of_all():
    """Every path through small lattices, costs added up plainly."""
    from itertools import product

    fix = restorer(["the idiot stupid loser scum clown till toll tell"] * 30)
    for token in ("1d10t", "t0||", "sc.u.m", "t1ll", "cl0wn", "$+upid", "lllos3r"):
        found = []
        for path in product(*[X.options(token, i) for i in range(len(token))]):
            word, cost = "".join(c for c, _ in path), sum(p for _, p in path)
            symbols = [0, 0, *(X.symbol(c) for c in word), 0]
            cost += sum(float(fix.model.cost[a, b, c]) for a, b, c in zip(symbols, symbols[1:], symbols[2:]))
            found.append((round(cost, 4), word))
        best = X.decode(token, fix.model)
        assert min(found)[0] == min(c for c, w in found if w == best)


def test_every_script_has_evidence_and_repeats_count_once():
    for text in ("какой идиот", "ηλίθιε", "أنت غبي", "あなたは馬鹿", "तुम मूर्ख"):
        assert len(X.text_buckets(text)) > 0
    evidence = np.zeros(X.BUCKETS)
    strong, weak = X.text_buckets("idiot"), X.text_buckets("moron")
    evidence[strong], evidence[weak] = 3.0, 2.0
    model = X.ToxicityModel(None, evidence, np.ones(X.TOP + 1))
    assert model.strongest("idiot " * 500 + "moron").tolist() == [3.0, 2.0, 0.0]


def test_held_out_toxicity(spark, tmp_path):
    words = "ba ko mi ru ta ne so li fa du".split()
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, 40)) for _ in range(600)]
    toxic = [i % 6 == 0 for i in range(600)]
    texts = [t + (" idiot" if i % 12 else " 1d10t") if bad else t for i, (t, bad) in enumerate(zip(texts, toxic))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = X.op4_toxicity(spark, str(tmp_path)).filter("held_out").collect()
    assert rows and all(r["predicted"] == toxic[r["doc_id"]] for r in rows)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m.group())]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


TEXTS = [
    "", "a@b.co_x@y.com z@w", "1.2.3.4.5 300.1.1.1 001.002.003.004 1.2.3.04567", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111111222 12",
    "+1 (243) 555-5526 and ++49 30 1234567. +1+2+3 +44 20 7946 0958-", "日本 😀 a.b@c.d 😀 10.0.0.1", "@@a@b.c@d.e a@b..c a@-.-", "5" * 5000, "a" * 5000 + "@x.y",
    "x@y." + "z." * 3000 + "q", " ".join(f"u{i}@h{i}.org" for i in range(700)),
]


def test_base_spans_and_positions(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = P.find(P.candidates(docs), P.SpanModel({}, {})).select("doc_id", P.joined(F.col("spans")).alias("s"))
    for r in found.collect():
        assert (r["s"].split(",") if r["s"] else []) == base_spans(TEXTS[r["doc_id"]])


def test_query_keeps_base_spans(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in P.op2_personal_data(spark, sf_dir).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",") if r["spans"] else [])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w.startswith(k) for w in want) for k in P.KINDS]


def test_weak_labelers_are_weighed():
    right, hit, share = P.expectation_maximisation({(1, 1, 1): 60, (1, 0, 0): 20, (-1, -1, 0): 80, (-1, 1, 0): 10})
    assert right[1, 1, 1] > 0.9 > 0.2 > right[-1, -1, 0] and hit[0][1] > hit[2][1]
    cells = [((1, 1, 1), (16, 3), 60), ((-1, -1, 0), (7, 1), 80)]
    weights = P.train_classifier(cells, right)
    assert len(weights) == 11


def test_looser_spans(spark):
    texts = [f"write to me: joe{i} (at) gmail (dot) com or tel 030 1234 567{i % 10}, host 10[.]0[.]0[.]{i}" for i in range(40)] + ["we met at the gate at noon"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = P.candidates(docs)
    rows = {r["doc_id"]: r["s"] for r in P.find(seen, P.learn(seen)).select("doc_id", P.joined(F.col("spans")).alias("s")).collect()}
    assert all({x.split(":")[0] for x in rows[i].split(",")} == {"email", "phone", "ip"} for i in range(40))
    assert all(rows[i] == "" for i in range(40, 80))


def test_spans_clear_of_others_against_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(8)
    for size in (0, 1, 5, 700):
        def draw(n):
            return sorted({(a, a + rnd.randint(1, 6)) for a in (rnd.randint(0, 4 * size + 5) for _ in range(n))})

        loose, taken = draw(size), draw(size // 2)
        row = spark.createDataFrame([([(a, b, f"v{a}", "") for a, b in loose], [(a, b, "", "") for a, b in taken])], f"l {P.SPANS}, t {P.SPANS}")
        got = [(r["start"], r["end"]) for r in row.select(P.free(F.col("l"), F.col("t")).alias("x")).first()["x"]]
        assert sorted(got) == [(a, b) for a, b in loose if all(d <= a or b <= c for c, d in taken)]


def test_a_long_text_of_spans_takes_no_square_of_time(spark):
    import time

    text = " ".join(f"user{i} at mail{i} dot com, 0{i % 90 + 10} 555 {i % 9000 + 1000}, x{i}@y{i}.org" for i in range(8_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    seen = P.candidates(docs)
    row = P.find(seen, P.learn(seen)).first()
    assert len(row["base_email"]) == 8_000 and len(row["spans"]) >= 8_000
    assert time.time() - start < 60
