from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
from cairn.llm import eval_leaks as E
from cairn.llm import mixing as M
from cairn.llm import residue as R
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

# ---- leaks


def words(t):
    return re.findall(r"[^\W_]+", (t or "").casefold())


def brute(docs, items):
    runs = defaultdict(set)
    for i, p in items:
        w = words(p)
        for k in range(len(w) - 9):
            runs[tuple(w[k : k + 10])].add(i)
    return {(d, i) for d, t in docs for k in range(len(words(t)) - 9) for i in (lambda s: s if len(s) < 3 else ())(runs.get(tuple(words(t)[k : k + 10]), ()))}


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    v = [f"w{k}" for k in range(60)] + ["été", "中文", "A_b"]
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(5, 40)))) for k in range(30)] + [(90, None), (91, "")]
    shared = " ".join(v[:10])
    items += [(100 + k, shared + f" own{k} " + " ".join(v[k + 5 : k + 20])) for k in range(3)]
    docs = [(200, shared), (201, None), (202, ""), (203, shared.upper())]
    for k in range(80):
        w = words(rng.choice(items)[1])
        cut = w[rng.randint(0, 3) : rng.randint(8, 30)]
        docs.append((k, rng.choice([" ", "-", "\n* ", "_"]).join([rng.choice(v) for _ in range(12)] + cut + [rng.choice(v)])))
    want = brute(docs, items)
    got = set(map(tuple, E.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, prompt string")).collect()))
    assert len(want) > 20 and got == want


def test_leaks_in_blocks_and_long_texts(spark, monkeypatch):
    prompt = " ".join(f"p{k}" for k in range(30))
    long = " ".join(f"z{k % 977}" for k in range(200_000)) + " " + prompt
    docs, items = spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame([(7, prompt)], "item_id long, prompt string")
    monkeypatch.setattr(E, "ITEM_WINDOWS", 4)
    assert list(map(tuple, E.found(docs, items).collect())) == [(1, 7)]
    assert E.found(docs, items.where("false")).count() == 0 and E.found(docs.where("false"), items).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 63), st.integers(0, 63), st.integers(0, 63))
def test_multi_index_misses_none_within_radius(prints, a, b, c):
    p = np.array(prints, np.uint64)
    q = p ^ np.uint64((1 << a) | (1 << b) | (1 << c))
    probe, entry = E.MultiIndex(p, 3).within(q)
    assert set(range(len(p))) <= {int(x) for x, y in zip(probe, entry) if x == y}


# ---- mixing


def test_water_filling():
    got = M.water_fill([("a", 0.5, 1, 100), ("b", 0.25, 10, 100), ("c", 0.25, 10, 100)], 300)
    assert got == {"a": 100.0, "b": 100.0, "c": 100.0}
    assert M.water_fill([("a", 1, 2, 10)], 100) == {"a": 20.0} and M.water_fill([], 5) == {}
    got = M.water_fill([("a", 0.6, 1, 60), ("b", 0.3, 1, 60), ("c", 0.1, 9, 60)], 180)
    assert got["a"] == got["b"] == 60 and abs(got["c"] - 60) < 1e-9


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(1, 5), st.integers(1, 1000)), min_size=1, max_size=8))
def test_water_filling_is_feasible(rows):
    rows = [(str(k), *r) for k, r in enumerate(rows)]
    total = sum(r[3] for r in rows)
    got = M.water_fill(rows, total)
    assert all(got[s] <= cap * n + 1e-6 for s, _, cap, n in rows) and abs(sum(got.values()) - total) < 1e-6 * total


def test_mix(spark):
    rng = random.Random(6)
    rows = [(k, "big" if k % 3 else "small", " ".join(f"t{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 60)))) for k in range(900)] + [(901, "big", None), (902, None, "no source"), (903, "small", ""), (904, "other", "x y z")]
    rows += [(1000 + k, "small", rows[0][2]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 1.0, 1), ("small", 1.0, 2), ("absent", 1.0, 3), ("other", None, 1)], "source string, target_share double, max_repeats int")
    r = {x.source: x for x in M.report(docs, targets).collect()}
    assert abs(r["big"].actual_share - 0.5) < 0.01 and abs(r["small"].actual_share - 0.5) < 0.01 and r["small"].most_copies <= 2 and r["big"].most_copies <= 1
    assert r["other"].drawn_tokens == 0 and r["absent"].tokens == 0 and r["absent"].epochs is None
    m = M.mix(docs, targets)
    assert m.where("doc_id >= 1000").count() == 0 and m.select("doc_id").distinct().count() == m.count()
    assert m.exceptAll(M.mix(docs, targets)).count() == 0 and m.exceptAll(M.mix(docs, targets, seed=12)).count() > 0
    assert M.mix(docs.where("false"), targets).count() == 0


# ---- residue

BAD = {
    "placeholder": ["Dear {{ name }}, your order is ready.", "Welcome to [company name], the place for teams.", "Contact %%TEAM%% about it.", "This page describes <your table here> and more.", "Version __NAME__ was released by ${who}."],
    "filler": ["Lorem ipsum dolor sit amet consectetur adipiscing elit.", "Content goes here. Content goes here.", "Dies ist nur ein Blindtext.", "Texto de relleno.", "此处为占位文本，请替换为正式内容。", "blah blah blah blah blah blah blah", "foo bar foo bar foo bar foo bar foo bar foo bar"],
    "error_page": ["404 Not Found", "Access denied. You don't have permission to view /x.", "Session expired. Please log in again.", "Seite nicht gefunden.", "La página que busca no existe. Error 404.", "页面不存在或已被删除。", "Oops! Something went wrong on our end.", "Home | Help | About\n\nAll quiet at this place.\n\nStatus | Acme 2020"],
    "script_notice": ["Please enable JavaScript to continue.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Active JavaScript para ver esta página.", "请启用 JavaScript 后重新加载本页面。", "Loading Acme... if nothing happens, allow JS.", "You need to enable JavaScript to run this app."],
}
FINE = [
    "In the template, write `{{ NAME }}` and it is filled in.", "If the gateway answers 502 Bad Gateway, raise `limit` to 3.", "We ask users to enable JavaScript only for the chart.", "A 404 Not Found from `load` means the table has not been built.", 'The handler shows "Something went wrong" when `x` is set.',
    "Our tests feed lorem ipsum to the tokenizer and count 3 tokens.", "Rate limits: too many requests make `f` return status 429.", "```\nDear {{ name }},\nLorem ipsum dolor sit amet consectetur\n```", 'x = "{{ name }}";', "Keep the cache small. It is read often.", "The docs also work with JavaScript disabled, because `r` renders on the server.",
]


def test_residue(spark):
    rows, want, k = [], {}, 0
    for kind, texts in BAD.items():
        for t in texts:
            for form in (t, f"# Notes\n\nThe cache is cleared every night.\n\n{t}\n\nThe index is kept.") if "|" not in t else (t,):
                k += 1
                rows.append((k, "s", form))
                want[k] = kind
    for t in FINE:
        k += 1
        rows.append((k, "s", t))
    rows += [(900, None, None), (901, "s", ""), (902, "s", " ".join(f"word{k % 999}" for k in range(100_000))), (903, "s", "a.b-" * 50_000), (904, "s", "| x " * 50_000), (905, "s", "- " * 50_000), (906, "s", "1.1" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("hash", F.lit(1))
    got = {r.doc_id: r.residue_kind for r in R.found(docs).collect()}
    texts = {r[0]: r[2] for r in rows}
    assert {texts[i] and texts[i][:80]: (got.get(i), want.get(i)) for i in set(got) | set(want) if got.get(i) != want.get(i)} == {}
    assert R.kept(docs).count() == len(rows) - len(want)
    assert R.found(docs.where("false")).count() == 0


def test_mix_counts_a_text_for_a_source_that_takes_part(spark):
    docs = spark.createDataFrame([(1, None, "one two three"), (2, "none", "one two three"), (3, "b", "one two three"), (4, "a", "one two three"), (5, "zero", "four five"), (6, "a", "four five"), (7, "a", "six"), (8, "none", "seven eight"), (9, "nan", "six"), (0, "nocap", "six")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2), ("zero", 0.0, 3), ("nan", float("nan"), 3), ("nocap", 0.5, 0)], "source string, target_share double, max_repeats int")
    assert sorted((r.doc_id, r.source) for r in M.texts(docs, targets=targets).collect()) == [(3, "b"), (6, "a"), (7, "a"), (8, "none")]
    assert {r.doc_id for r in M.mix(docs, targets, total_tokens=12).collect()} == {3, 6, 7}


def test_similar_windows_are_all_found(spark):
    """Windows of 24 words with up to two of them changed, against every window by brute force."""
    import random

    import numpy as np
    import pytest

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    prompts = [rng.choices(vocabulary, k=60) for _ in range(12)]
    texts = []
    for k in range(150):
        own = list(rng.choice(prompts)[(s := rng.randint(0, 30)) : s + 26])
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(rng.choices(vocabulary, k=rng.randint(0, 30)) + own + rng.choices(vocabulary, k=rng.randint(0, 30)))
    items = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(prompts)], "item_id long, prompt string")
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {tuple(r) for r in E.leaks(docs, items, window=24, similarity=0.92).collect()}
    memo = E._Hash()
    hashed = [np.array(E.word_hashes(" ".join(p), memo), np.uint64) for p in prompts]
    runs = {h[k : k + 24].tobytes() for h in hashed for k in range(len(h) - 23)}
    known, counts = np.unique(np.array([np.frombuffer(r, np.uint64) for r in runs]), return_counts=True)
    weigh = lambda w: 1.0 / np.log1p(counts[np.searchsorted(known, w)])
    want = set()
    for d, t in enumerate(texts):
        w = np.array(E.word_hashes(" ".join(t), memo), np.uint64)
        for i, h in enumerate(hashed):
            for a in range(len(h) - 23):
                item, weights = h[a : a + 24], weigh(h[a : a + 24])
                if any(((w[b : b + 24] == item) * weights).sum() >= 0.92 * weights.sum() - 1e-9 for b in range(len(w) - 23)):
                    want.add((d, i))
    assert got == want and len(want) > 50
    assert len(want) > len({tuple(r) for r in E.leaks(docs, items, window=24).collect()})
    with pytest.raises(ValueError):
        E.leaks(docs, items, similarity=0.7)


#: Messages in wordings that no phrase rule was made from; each is a text of its own.
UNLISTED = {
    "placeholder": ["<<COMPANY_NAME>> welcomes you to the new season.", "Signed on behalf of [CLIENT NAME] this spring.", "Call XXX-XXX-XXXX between nine and five.", "((Product title)) is now in stock.", "Please send the form to ::OFFICE:: by Friday."],
    "filler": ["TKTK intro to be supplied", "Body copy to be written by the team.", "Faux texte à remplacer plus tard.", "Testo di esempio per la sezione.", "Texto provisório desta página."],
    "error_page": ["La page demandée est introuvable.", "La pagina richiesta non esiste.", "A página solicitada não existe ou mudou.", "De opgevraagde pagina bestaat niet meer.", "Запрошенная страница не найдена.", "お探しのページは見つかりません。", "L'accès à ce site vous est interdit.", "La tua sessione è scaduta.", "Toegang tot deze dienst is geweigerd.", "This resource is no longer with us."],
    "script_notice": ["JavaScript est désactivé dans votre navigateur.", "Per vedere il sito attiva JavaScript.", "Ative os cookies para ler o artigo.", "JavaScript moet ingeschakeld zijn.", "Включите JavaScript в браузере.", "JavaScriptを有効にしてください。", "Les cookies sont requis pour lire la suite."],
}
SPEAKS = [
    "Si la page est introuvable, `load` renvoie une erreur et le cache est vidé.", "Wenn die Seite nicht gefunden wird, wird sie neu gebaut. Danach läuft der Dienst weiter wie zuvor.", "The reader keeps the page in memory. A file that is not found is skipped, and the next one is read.", "Use `<<` to shift bits and [[1, 2], [3, 4]] for a matrix of two rows.",
    "Our client retries when the server does not respond, up to five times, and then writes the time to the log.", "Der Browser führt Skripte aus. Das Modul benötigt dafür einen Faden je Kern und einen Puffer.",
]


def test_unlisted_messages(spark):
    rows, want, k = [], {}, 0
    for kind, texts in UNLISTED.items():
        for t in texts:
            k += 1
            rows.append((k, "s", t))
            want[k] = kind
    rows += [(500 + n, "s", "The cache is cleared every night.\n\n" + t + "\n\nThe index is kept as it is, and the log is read once a day.") for n, t in enumerate(SPEAKS)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.residue_kind for r in R.found(docs).collect()}
    wrong = [(rows[i - 1][2], got.get(i)) for i in want if got.get(i) != want[i]]
    assert len(wrong) <= 0.1 * len(want), wrong
    assert {i for i in got if i >= 500} == set()


def test_recurrence_decides(spark):
    """The same message with other names, in long texts: content where it stands once, residue where sources share it."""
    names = ["Acme", "Borel", "Cidra", "Dunlo"]
    filled = lambda k, n: "\n\n".join([*(f"Row {j} of table {k} is kept in order and read by worker {j * k}." for j in range(12)), f"Access to the archive of {n} is interdit."])
    many = [(k, "a" if k % 2 else "b", filled(k, n)) for k, n in enumerate(names)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id: r.residue_kind for r in R.found(df(many)).collect()} == dict.fromkeys(range(4), "error_page")
    assert R.found(df(many[:1])).count() == 0 and R.found(df([(i, "a", t) for i, _, t in many])).count() == 0


def test_pages_of_any_length(spark):
    page = "Home | Help | About\n\nAll quiet at this place.\n\nStatus | Acme 2020"
    rows = [(1, "s", page), (2, "s", page + "\n" * 6000), (3, "s", "\n".join(f"Entry {k} | Help | About" for k in range(400)) + "\n\nAll quiet at this place.")]
    got = {r.doc_id: r.residue_kind for r in R.found(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {1: "error_page", 2: "error_page", 3: "error_page"}


def test_kept_rows_and_columns(spark):
    rows = [(k, "s", "404 Not Found" if k % 3 == 0 else "The index is kept.", k) for k in range(60)] + [(None, "s", "404 Not Found", 1), (7, "s", "The index is kept.", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, hash long")
    out = R.kept(docs)
    assert out.columns == docs.columns and out.count() == 42 and out.where("doc_id = 7").count() == 2 and out.where("doc_id is null").count() == 1


def test_kept_tells_large_ids_apart_beside_nulls(spark):
    big = 2**60
    rows = [(big + k, "s", "404 Not Found" if k % 2 else "The index is kept.") for k in range(40)] + [(None, "s", "The index is kept.")]
    out = R.kept(spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1))
    assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [big + k for k in range(0, 40, 2)] and out.count() == 21
