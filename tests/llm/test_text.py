"""Problems 3, 4, 6, 7 and 8: tokens, answers, leaks, mixture, sentences."""

import math
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import p3_tokens, p4_answers, p6_leaks, p7_mixture, p8_sentences
from lodestack.llm.answers import defects, is_empty, language, wanted
from lodestack.llm.bpe import START, Pieces
from lodestack.llm.sentences import Model, units
from lodestack.llm.tiling import passage, tiles, words

MERGES = [(0, "a", "b"), (1, "ab", "c"), (2, "b", "c"), (3, START, "a"), (4, "c", "c"), (5, "cc", "ab"), (6, "a", "a"), (7, "aa", "aa")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcd" + START, max_size=12), max_size=20))
def test_incremental_counts(texts):
    p = Pieces(MERGES)
    assert list(p.counts(texts)) == [len(p.merged(START + w)) for w in texts]
    assert list(p.counts(sorted(texts))) == [len(p.merged(START + w)) for w in sorted(texts)]


def test_token_counts(spark):
    merges = spark.createDataFrame(MERGES, "merge_rank int, left_piece string, right_piece string")
    texts = [("k1", "abc abc  aaaa\nb"), ("k1", "abc abc  aaaa\nb"), ("k2", ""), ("k3", " \t "), ("k4", "x" * 300)]
    p = Pieces(MERGES)
    want = {k: sum(len(p.merged(START + w)) for w in t.split()) for k, t in texts}
    df = spark.createDataFrame(texts, "key string, text string")
    assert {r.key: r.tokens for r in p3_tokens.token_counts(df, merges).collect()} == want
    assert p3_tokens.token_counts(df.limit(0), merges).count() == 0


def test_token_totals_add_up(spark, data):
    rows = p3_tokens.p3_text_tokens(spark, data).toPandas()
    totals = p3_tokens.p3_token_totals(spark, data).toPandas()
    by_source = totals[(totals.language == "*") & (totals.area == "*")].groupby("table").tokens.sum().to_dict()
    assert by_source == rows.groupby("table").tokens.sum().to_dict()


PROMPT = "You are a careful code reviewer.\nProject rules:\n- The queue must not rotate the window here.\n\nReview the code above and report every real problem.\nAnswer in plain text."


@pytest.mark.parametrize(
    "text,found",
    [
        (None, ["empty"]), ("", ["empty"]), ("\u200b \n", ["empty"]), ("```\n\n```", ["empty"]), ("{}", ["empty"]), ('{"summary": "", "issues": []}', ["empty"]), ("N/A", ["empty"]), ("## Summary\n", ["empty"]),
        ("No issues found.", []), ('{"summary": "No issues found.", "issues": []}', []), ('{"summary": "The cache leaks", "issues": [{"file": "a', ["truncated"]), ("The lock in `a.ts` is open and the", []), ("- **low** `a.ts:3` The lock (see", ["truncated"]), ("It says:\n```js\nlet a = {", ["truncated"]),
        ("I'm sorry, but I can't help with reviewing this code.", ["refusal"]), ('The log says "I\'m sorry, but I can\'t open the socket" in `a.ts`, and that is the cause of the bug.', []), (PROMPT, ["copies_prompt"]), (PROMPT.lower().replace("\n", " "), ["copies_prompt"]),
        ("Die Sperre in `a.ts` wird nicht frei, wenn die Prüfung scheitert, und das ist ein Fehler.", ["other_language"]), ("Leider kann ich diese Prüfung nicht übernehmen.", ["refusal", "other_language"]),
    ],
)
def test_defects(text, found):
    assert defects(text, PROMPT)[0] == found


def test_languages():
    assert [language(t) for t in ("The cache is not the cause of it.", "これは意図的です。", "目录会一直锁定。", "", "x1 y2")] == ["en", "ja", "zh", None, None]
    assert wanted(PROMPT + "\nWrite the answer in German.") == "de" and wanted(PROMPT) == "en"
    assert not is_empty("OK, the queue is fine.")


def test_abrupt_endings_from_the_corpus(spark):
    whole = [(f"r{i}", "p", f"The queue{i} keeps the lock. The limit rose to {i} items per fragment. We had no answer.", None) for i in range(12)]
    open_ends = [("a", "p", "The queue keeps the lock. The limit rose to 3 items per fragment", None), ("b", "p", "The queue keeps the lock. The limit rose to", None), ("c", None, None, None), ("a", "p", None, None)]
    df = spark.createDataFrame(whole + open_ends, "id string, prompt_id string, raw_response string, created_at timestamp")
    prompts = spark.createDataFrame([("p", PROMPT, None)], "id string, text string, created_at timestamp")
    assert sorted(map(tuple, p4_answers.answer_defects(df, prompts).collect())) == [("b", "truncated"), ("c", "empty")]
    assert p4_answers.answer_defects(df.limit(0), prompts).count() == 0


def slow_tiles(a, b, least):
    """Greedy string tiling by its definition: mark the longest unmarked common run, again and again."""
    ua, ub, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(out)
        ua[i : i + n], ub[j : j + n] = [True] * n, [True] * n
        out.append((i, j, n))


def test_tiling():
    random.seed(4)
    for _ in range(120):
        a, b = ([random.choice("abcde") for _ in range(random.randint(0, 24))] for _ in range(2))
        fast, slow = tiles(a, b, 3), slow_tiles(a, b, 3)
        assert sorted(n for _, _, n in fast)[-1:] == sorted(n for _, _, n in slow)[-1:]
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in fast)
        assert sum(n for *_, n in fast) >= 0.8 * sum(n for *_, n in slow)
    x = [f"w{i}" for i in range(40)]
    own = list(range(38))
    told = lambda b, own=own: passage(tiles(x, b, 3), own, 40, 3)
    assert told(["z"] * 5 + x[3:10] + ["new"] + x[11:18] + ["z"] * 5)[0] == 15 and told(x[3:10] + ["new"] + x[11:17])[0] == 14
    assert told(x[30:] + x[:30])[1] == 1.0
    assert told(["other" if i % 4 == 3 else y for i, y in enumerate(x[:17])])[0] >= 15
    assert told(x[:30], list(range(20, 38)))[0] < 15 and told(x[:36], list(range(20, 38)))[0] >= 15  # the first 20 words are an instruction
    assert told([], own) == (0, 0.0) == told(x, [])
    assert words("**Map** `fold_left-Item` it's") == ["map", "foldleftitem", "its"]


def test_answers_without_limits():
    """Long refusals, JSON after a long preamble, requests at the top of long prompts, many fillers, and every defect of one answer."""
    from lodestack.llm.answers import defects, end_grams

    sorry = "I am sorry, but I cannot review this. " + "There are rules for this kind of thing and they are what they are for all of us here. " * 12
    assert "refusal" in defects(sorry, "Review this.")[0] and defects(sorry + "`foldMap` loses 3 rows in a.ts.", "Review this.")[0] == []
    assert "refusal" in defects("The text is long. It has parts. They are many. So I must decline.", "Review this.")[0]
    preamble = "Here is what was found in the change after a close look at all of it. " * 10
    assert defects(preamble + '\n{"summary": "Fine.", "issues": []}', "Review this.")[0] == [] and defects(preamble + '\n{"summary": "Fine.", "issues": [', "Review this.")[0] == ["truncated"]
    asks = "Answer in German.\n" + "The cache is emptied too early and the queue then loses its messages.\n" * 30
    german = "Die Warteschlange verliert ihre Nachrichten, weil der Cache zu früh geleert wird."
    assert defects(german, asks)[0] == [] and defects("The queue loses what it holds because the cache is cleared too early.", asks)[0] == ["other_language"]
    assert defects("N/A " * 8, "x")[0] == ["empty"] and defects(None, None)[0] == ["empty"] and defects("- **TODO** TODO TODO TBD n/a\n", "x")[0] == ["empty"]
    assert defects(asks, asks)[0] == ["copies_prompt", "other_language"]
    assert defects("```ts\nlet a = {\n  b: 1,\n};\n```\nIt is fine.", "Review this.")[0] == []  # braces in code are no JSON
    codes, ends = end_grams("The cache is full. So it is.")
    assert codes.shape == (7, 11) and ends.tolist() == [False, False, False, True, False, False, True] and end_grams("")[0].shape == (0, 11)


def test_leaks(spark):
    own = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(6)]
    head = "You are given a change set and the rules of the project; name every defect. "
    items = spark.createDataFrame([(k, head + t, 0) for k, t in enumerate(own)] + [(9, None, 0), (10, "", 0)], "item_id long, text string, seeds int")
    w = own[2].split()
    docs = [
        (1, "Intro. " + own[1].upper().replace(" ", "\n> ") + " End."), (2, "x " + " ".join(w[5:12] + ["other"] + w[13:24]) + " y"), (3, " ".join(w[5:15])), (4, head), (5, None), (6, ""), (7, " ".join(own[3].split()[30:] + own[3].split()[:30])), (8, "x " + " ".join(w[5:12] + ["other"] + w[13:24]) + " y"),
    ]
    got = p6_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (7, 3), (8, 2)]
    assert p6_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string").limit(0), items).count() == 0


def test_leaks_of_repeated_items_and_replaced_words(spark):
    """An item in three suites, with other instructions too, is found for each; so are passages with every fourth word replaced."""
    text = " ".join(f"v{i}" for i in range(60))
    heads = ["", "", "State in one word which of the lines below is wrong: ", "Read this and answer briefly, without any code or list. "]
    rows = [(k, h + text) for k, h in enumerate(heads)] + [(20 + k, h + " ".join(f"u{k}y{i}" for i in range(50))) for k, h in enumerate(heads * 3)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    w = text.split()
    changed = [x if i % 4 != 3 else "other" for i, x in enumerate(w[10:27])]
    docs = [(1, "so " + text), (2, "and " + " ".join(changed) + " then"), (3, " ".join(w[30:44])), (4, "State in one word which of the lines below is wrong: " + " ".join(w[:8])), (5, " ".join(x for y in w[10:26] for x in (y, "the")[: 1 + (int(y[1:]) % 4 == 0)]))]
    got = sorted(map(tuple, p6_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()))
    assert got == [(d, k) for d in (1, 2, 5) for k in range(4)]


def test_leaks_of_passages_that_items_share(spark):
    """A passage that many items share, under one instruction and with other questions after it, is found for each: whole, 15 words of it, and reworded."""
    head = "Read the text below and answer in one short sentence without any code. "
    body = [f"p{i}" for i in range(50)]
    rows = [(k, head + " ".join(body) + " " + " ".join(f"q{k}y{i}" for i in range(20))) for k in range(5)] + [(20 + k, head + " ".join(f"u{k}y{i}" for i in range(60))) for k in range(6)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    reworded = [x if i % 4 != 3 else "other" for i, x in enumerate(body[5:30])]
    docs = [(1, "so " + " ".join(body)), (2, " ".join(body[20:35])), (3, "and " + " ".join(reworded) + " then"), (4, " ".join(body[20:34])), (5, head), (6, head + " ".join(body[:10])), (7, None), (8, "")]
    got = sorted(map(tuple, p6_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()))
    assert got == [(d, k) for d in (1, 2, 3) for k in range(5)]


def test_leaks_of_items_made_of_phrases(spark):
    """Items all of whose seeds stand in many others are found by 15 words in a row, short ones by all their words, but not by single phrases."""
    phrases = [[f"f{k}y{i}" for i in range(4)] for k in range(5)]
    rng = random.Random(3)
    rows = [(k, " ".join(w for f in rng.choices(phrases, k=9) for w in f)) for k in range(40)] + [(200, " ".join(phrases[0]))]
    text = rows[7][1].split()
    docs = [(1, "x " + " ".join(text[10:25]) + " y"), (2, " ".join(text[10:24])), (3, " x ".join(" ".join(f) for f in phrases[1:3])), (4, "z " + " ".join(phrases[0]) + " z")]
    got = sorted(map(tuple, p6_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")).collect()))
    runs = lambda words, n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    assert got == [(d, k) for d, t in docs for k, i in rows if runs(t.split(), min(15, len(i.split()))) & runs(i.split(), min(15, len(i.split())))]
    assert (1, 7) in got and (4, 200) in got and (2, 7) not in got


def test_seeds_of_many_items(spark):
    """With more items, chance meetings of their seeds don't hide reworded passages: what few of them share is no phrase."""
    rng = random.Random(6)
    triples = [[f"t{k}y{i}" for i in range(3)] for k in range(4000)] * 3
    rng.shuffle(triples)
    rows = [(k, " ".join(w for t in triples[k * 20 : k * 20 + 20] for w in t)) for k in range(600)]
    docs = [(1, "so " + " ".join(w for t in triples[60:68] for w in (*t, "other")) + " then"), (2, " ".join(triples[80]))]
    got = p6_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 3)]


def test_quotas():
    tokens, target, repeats = {"a": 1000, "b": 100, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 3, "c": 2}
    take, exponent = p7_mixture.quotas(tokens, target, repeats)
    assert exponent == 1.0 and abs(take["a"] / take["b"] - 5 / 3) < 1e-9 and take["b"] <= 300
    take, exponent = p7_mixture.quotas(tokens, target, repeats, budget=1000)
    assert 0 < exponent < 1 and abs(take["b"] - 300) < 1e-3 and abs(sum(take.values()) - 1000) < 1e-3
    shares = {"x": 0.7, "y": 0.2, "z": 0.1}
    a = p7_mixture.by_entropy(shares, 1.0)
    w = [v**a for v in shares.values()]
    assert abs(-sum(v / sum(w) * math.log(v / sum(w)) for v in w) - 1.0) < 1e-6


def test_exponents_against_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        names = "abcde"[: rng.randint(2, 5)]
        tokens = {s: rng.randint(50, 100_000) for s in names}
        target = {s: rng.random() + 0.01 for s in names}
        total = sum(target.values())
        target = {s: t / total for s, t in target.items()}
        repeats = {s: rng.randint(1, 6) for s in names}
        take, exponent = p7_mixture.quotas(tokens, target, repeats, epochs=0.75)
        all_tokens, whole = sum(tokens.values()), 0.75 * sum(tokens.values())

        def weights(a):
            w = {s: (tokens[s] / all_tokens) ** (1 - a) * target[s] ** a for s in names}
            return {s: x / sum(w.values()) for s, x in w.items()}

        fits = [k / 2000 for k in range(2001) if all(x * whole <= tokens[s] * repeats[s] * (1 + 1e-9) for s, x in weights(k / 2000).items())]
        first_break = next((k / 2000 for k in range(2001) if k / 2000 not in set(fits)), 1.0)
        assert exponent == 1.0 if len(fits) == 2001 else exponent >= first_break - 1e-3
        assert abs(sum(take.values()) - whole) < 1e-6 * whole and all(take[s] <= tokens[s] * repeats[s] * (1 + 1e-9) for s in names)
        take, exponent = p7_mixture.quotas(tokens, target, repeats, entropy=p7_mixture.TARGETS)
        shares = [x / sum(take.values()) for x in take.values()]
        assert exponent > 63 or abs(-sum(x * math.log(x) for x in shares) + sum(x * math.log(x) for x in target.values())) < 1e-3  # equal sources stay equal
        assert any(take[s] >= tokens[s] * repeats[s] * (1 - 1e-9) for s in names)


def test_mixture_at_a_budget(spark, data):
    from lodestack.llm.queries import QUERIES

    folder = data.replace("sf0.001", "sf0.01")
    rows = {r.source: r for r in QUERIES["p7_budget_shares"](spark, folder).collect()}
    exponent = next(iter(rows.values())).exponent
    assert 0 < exponent < 1
    uses = p7_mixture.mixture(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/source_weights.parquet"), epochs=0.75)[0].toPandas()
    used = (uses.tokens * uses.uses).groupby(uses.source).sum()
    for s, r in rows.items():
        assert r.used_tokens == used.get(s, 0) and r.most_uses <= r.max_repeats and abs(r.share_reached - used.get(s, 0) / used.sum()) < 1e-9
    even = {r.source: r for r in QUERIES["p7_entropy_shares"](spark, folder).collect()}
    shares = [r.share_reached for r in even.values() if r.share_reached > 0]
    live = [r.target_share for r in even.values() if r.documents > 0]
    assert abs(-sum(x * math.log(x) for x in shares) + sum(x / sum(live) * math.log(x / sum(live)) for x in live)) < 0.02


def test_mixture(spark):
    docs = [(i, f"text number {i} " * (1 + i % 7), "Big ", i) for i in range(300)] + [(1000 + i, f"small {i}", "small", i) for i in range(20)] + [(2000, "small 3", "small", 0), (2001, None, "small", 0), (2002, "x", None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, uses int")
    goal = spark.createDataFrame([("big", 0.6, 1), ("small", 0.2, 3), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    uses, shares = p7_mixture.mixture(df, goal)
    u = uses.toPandas().set_index("doc_id")
    assert len(u) == len(docs) and u.uses[2000] == 0 and u.uses[2001] == 0 and u.uses[2002] == 0
    assert u[u.source == "big"].uses.max() <= 1 and u[u.source == "small"].uses.max() <= 3
    s = {r.source: r.share_reached for r in shares.collect()}
    assert abs(s["small"] - 0.25) < 0.02 and abs(s["big"] - 0.75) < 0.02 and s["none"] == 0
    assert p7_mixture.mixture(df.limit(0), goal)[0].count() == 0


EMPTY = Model({}, {}, {}, {})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\r>-*#`\"'()“”«»。」「…। ", max_size=60))
def test_units_cover(text):
    pos = 0
    for a, b in units(text, EMPTY, "en"):
        assert a >= pos and a < b and not text[pos:a].strip() and text[a:b] == text[a:b].strip()
        pos = b
    assert not text[pos:].strip()


def test_units_learned(spark, data):
    documents = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model, rest = p8_sentences.learned(p8_sentences.model_rows(documents.where("trim(text) <> ''").selectExpr("text", "'en' as lang")))
    assert rest is None
    m = Model(**model)
    assert m.abbreviation("vs", "en") and not m.abbreviation("done", "en") and m.start("The", "en") > 0 > m.start("the", "en")
    text = "## Summary\n\nDr. Null locks the queue vs. the cache. “Why is it stale?” asked the second reviewer. (It is so by design.) Done. See `a. b` in x.ts.\n\n- Hm... the shard looks idle.\n- OK?\n\n```js\na. b\n```\n問題です。「なぜ二回？」と質問がありました。"
    got = [text[a:b] for a, b in units(text, m, "en")]
    assert got == ["## Summary", "Dr. Null locks the queue vs. the cache.", "“Why is it stale?” asked the second reviewer.", "(It is so by design.)", "Done.", "See `a. b` in x.ts.", "- Hm... the shard looks idle.", "- OK?", "```js\na. b\n```", "問題です。", "「なぜ二回？」と質問がありました。"]


def test_units_with_a_small_broadcast(spark, data, monkeypatch):
    """Rows of the model that aren't broadcast reach the texts all the same: the units are those of the whole model."""
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    whole = {tuple(r) for r in p8_sentences.sentence_units(documents).collect()}
    for most in (1, 40):
        monkeypatch.setattr(p8_sentences, "MODEL_ROWS", most)
        assert {tuple(r) for r in p8_sentences.sentence_units(documents).collect()} == whole


def test_units_of_long_quotations():
    inner = "It is stale. " * 60
    text = f"He wrote “{inner.strip()}” and left. Then 'a. b {'x ' * 80}c' was read. Done."
    assert [text[a:b] for a, b in units(text, EMPTY, "en")] == [f"He wrote “{inner.strip()}” and left.", f"Then 'a. b {'x ' * 80}c' was read.", "Done."]


def test_units_cases(spark):
    rows = [(1, None, "en"), (2, " \n", "en"), (3, "One. Two.", None), (4, "One. Two.", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(tuple, p8_sentences.sentence_units(df).collect())) == [(3, 0, 4), (3, 5, 9), (4, 0, 4), (4, 5, 9)]
    assert p8_sentences.sentence_units(df.limit(0)).count() == 0


def test_queries_run(spark, data):
    from lodestack.llm.queries import QUERIES

    columns = {"p1_found": ["commit_sha", "file"], "p2_found": ["chunk_id", "line"], "p4_found": ["response_id", "defect"], "p5_found": ["commit_sha", "file"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "start_char", "end_char"]}
    for name, want in columns.items():
        rows = QUERIES[name](spark, data).toPandas()
        assert list(rows.columns) == want and len(rows) and not rows.duplicated().any(), name
    assert isinstance(rows, pd.DataFrame)


def test_queries_with_sql(spark, data):
    """Queries that SQL can say give the rows that DuckDB gives."""
    import os

    import duckdb

    from lodestack.llm.queries import QUERIES, SQL

    duck = duckdb.connect()
    for f in os.listdir(data):
        duck.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    assert SQL
    for name, sql in SQL.items():
        df = QUERIES[name](spark, data)
        found = duck.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(r) for r in found.fetchall()), key=repr)
        assert want and sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == want
