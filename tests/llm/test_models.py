"""Language identification, toxicity, perplexity rules, token counts and decontamination."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import awkward
from fieldloom.llm import decontaminate, language_id, perplexity, token_counts, toxicity

SF = "/root/testdata/sf0.01"


# --- language -----------------------------------------------------------------------------------
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 3 != 1"))
    rows = language_id.identify(docs.filter("doc_id % 3 = 1"), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_backoff_reaches_shorter_ngrams(spark):
    train = spark.createDataFrame([("the thing that there", "en"), ("das ding dass dort", "de")] * 3, "text string, lang string")
    model = language_id.fit(train)
    found, score = model.predict(["thethat", "dingdas", "th", "12 !", None, "дом"])
    assert found[:5] == ["en", "de", "en", "und", "und"] and score[3] == score[4] == 0 and found[5] in ("de", "en")


def test_awkward_languages(spark):
    model = language_id.fit(awkward.frame(spark))
    got = language_id.identify(awkward.frame(spark), model).collect()
    assert len(got) == len(awkward.rows()) and {r.lang_pred for r in got if not (r.text or "").strip()} == {"und"}
    nothing = language_id.fit(awkward.empty(spark))
    assert {r.lang_pred for r in language_id.identify(awkward.frame(spark), nothing).collect()} == {"und"}
    assert language_id.identify(awkward.empty(spark), model).collect() == []


# --- toxicity -----------------------------------------------------------------------------------
def test_clauses_and_their_contexts():
    grammar = toxicity.Grammar({"idiot": 2.0}, {"vequ": 4.0})
    finder = grammar.finder()
    weight = lambda text: grammar.features(text, finder)
    assert weight("what an idiot.") == (2.0, 1) and weight("you IDIOT! bye") == (2.5, 1)
    assert weight("they are not idiot") == (0.5, 1) and weight("x said idiot") == (2.0 * 0.4, 1)
    assert weight('"idiot" x') == (0.8, 1) and weight("idiot. idiot") == (4.0, 2)
    assert weight("le vequeur") == (4.0, 1) and weight("aidiot idiotb kill") == (0.0, 0)
    assert weight("i will kill you") == (toxicity.DEFAULT_WEIGHT * 1.25, 1) and weight(None) == weight("") == (0.0, 0)


def test_product_automaton_is_closed():
    start, table = toxicity.GRAMMAR
    states = {s for s, _ in table}
    assert start in states and set(table.values()) <= states and len(table) == len(states) * len(toxicity.SYMBOLS)


def test_held_out_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    labels = docs.select("doc_id", "toxic").filter("doc_id % 3 != 1")
    grammar = toxicity.fit(docs, labels)
    got = toxicity.score(docs.filter("doc_id % 3 = 1"), grammar).select("toxic", "score").collect()
    caught = [r.score >= 0.7 for r in got if r.toxic == 1]
    wrong = [r.score >= 0.7 for r in got if r.toxic == 0]
    assert sum(caught) > 0.8 * len(caught) and sum(wrong) < 0.01 * len(wrong)


def test_awkward_toxicity(spark):
    nothing = awkward.frame(spark).selectExpr("doc_id", "cast(null as int) as toxic")
    assert toxicity.fit(awkward.empty(spark), nothing.selectExpr("doc_id", "doc_id % 2 as toxic")).stems == {}
    grammar = toxicity.fit(awkward.frame(spark), nothing)
    got = toxicity.score(awkward.frame(spark), grammar).collect()
    assert len(got) == len(awkward.rows()) and all(0 <= r.score < 0.7 for r in got)
    assert toxicity.score(awkward.empty(spark), grammar).collect() == []


# --- perplexity ---------------------------------------------------------------------------------
def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams, covered, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if grams[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_against_brute_force():
    sample = [r[1] for r in awkward.rows(long_words=2000)] + [
        "a b c a b c", "a a a a", "#x|\n#x|\n \n \n#x|", "x\ny\nx\ny\n\n", "p q r s\np q r t q r s", "\n", "a b"]
    got = perplexity.statistics(perplexity.words_of(pa.array(sample)))
    assert list(zip(*(got[c].tolist() for c in perplexity.STATISTICS))) == [brute_statistics(t) for t in sample]


def brute_kneser_ney(grams, order):
    """Interpolated modified Kneser-Ney by dictionaries, from counts of byte tuples."""
    levels = {order: Counter(grams)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: perplexity._discounts(np.array(list(levels[k].values()))) for k in levels}

    def p(g):
        if not g:
            return 1 / 257
        level, d = levels[len(g)], cut[len(g)]
        mates = [n for h, n in level.items() if h[:-1] == g[:-1]]
        if not mates:
            return p(g[1:])
        left = sum(d[min(n, 3)] for n in mates) / sum(mates)
        n = level.get(g, 0)
        return (n - d[min(n, 3)]) / sum(mates) + left * p(g[1:])

    return p


def test_model_against_brute_force(spark):
    texts = ["the cat sat on the mat", "the hat  is on\nthe cat", "a cat", "abracadabra abracadabra"]
    docs = spark.createDataFrame([(t, "en") for t in texts] + [("le chat est le chat", "fr")], "text string, lang string")
    model = perplexity.fit(docs, order=3)
    grams = [tuple(b if b not in b"\n" else 32 for b in t.encode()[i:i + 3]) for t in texts for i in range(len(t) - 2)]
    p = brute_kneser_ney(grams, 3)
    for test in ("the", "cat", "xyz", "caz", " on", "tat", "zca"):
        gram = perplexity.packed(np.frombuffer(test.encode(), np.uint8), 3)
        assert np.exp(model.log_probability(gram, model.langs["en"]))[0] == pytest.approx(p(tuple(test.encode())), rel=1e-4)


def test_a_model_in_shards_leaves_nothing_out(spark, monkeypatch):
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 6))) for _ in range(80)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(40)), lang) for i, lang in enumerate(["aa"] * 30 + ["bb", None] * 3)]
    rows += [(90, "QZ", "bb"), (91, None, "aa"), (92, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = perplexity.fit(docs)
    want = {r.doc_id: r.log_perplexity for r in perplexity.measure(docs, whole).collect()}
    monkeypatch.setattr(perplexity, "SHARD_NGRAMS", 300)
    cut = perplexity.fit(docs)
    assert len(cut.parts) > 5 and cut.langs == whole.langs
    for held in (perplexity.HELD_BYTES, 1):
        monkeypatch.setattr(perplexity, "HELD_BYTES", held)
        got = {r.doc_id: r.log_perplexity for r in perplexity.measure(docs, cut).collect()}
        assert got == {d: p if p is None else pytest.approx(p, rel=1e-6) for d, p in want.items()}
    for lang in whole.langs.values():
        for text in ("abcdeabc cab edcb", "zzzzzzz", "azbzczdz a", "XYa bdcÿ"):
            gram = perplexity.packed(np.frombuffer(text.encode(), np.uint8), 5)
            assert cut.log_probability(gram, lang) == pytest.approx(whole.log_probability(gram, lang), rel=1e-5)


def test_bands_reject_what_is_unlike_its_language(spark):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(200)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(300)), "xx") for i in range(300)]
    rows += [(900, " ".join("".join(rnd.choice("QZXJ#$%") for _ in range(6)) for _ in range(300)), "xx"), (901, "too short", "xx"),
             (902, "so so " * 100, "xx"), (903, rows[0][1], None)]
    got = {r.doc_id: r for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[900].base_failed and not got[900].kept and got[901].base_failed and got[902].base_failed
    assert sum(got[i].kept for i in range(300)) >= 298 and got[903].kept


def test_awkward_perplexity(spark):
    got = perplexity.judge(awkward.frame(spark)).collect()
    assert len(got) == len(awkward.rows()) and all(not r.kept for r in got if not r.text)
    assert perplexity.judge(awkward.empty(spark)).collect() == []


# --- token counts -------------------------------------------------------------------------------
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_edited_counts_equal_counting_anew():
    count = token_counts.Vocabulary.read(VOCABULARY).counter()
    rnd = random.Random(3)
    bits = [" ", "\n", "  ", "a", "foo bar", "'s", "\t\n x", "É ", ".", "\u00a0", "　", "12", " \n\n"]
    texts = ["", "a", " ", "\n\n ", *("".join(rnd.choice(bits) for _ in range(rnd.randrange(3000))) for _ in range(40))]
    for text in texts:
        chars, tree = token_counts.build_one(text, count)
        assert tree.total == count(text) and chars.sum() == len(text)
        for _ in range(4):
            edits = [{"start": s, "end": s + rnd.choice([0, 1, 5, 300]), "replacement": rnd.choice([*bits, None, "word " * 300])}
                     for s in (rnd.randrange(-3, len(text) + 3) for _ in range(rnd.randrange(5)))]
            clean = token_counts.clean_edits(edits, len(text))
            want, at = "", 0
            for s, e, new in clean:
                want, at = want + text[at:s] + new, e
            want += text[at:]
            text, chars, tree, _ = token_counts.edit_one(text, chars, tree, clean, count)
            assert text == want and tree.total == count(want) and chars.sum() == len(want)


def test_small_edits_leave_most_of_a_long_text_alone(spark):
    vocabulary = token_counts.Vocabulary.read(VOCABULARY)
    docs = awkward.frame(spark).selectExpr(
        "*", "array(named_struct('start', 50, 'end', 53, 'replacement', 'X Y'), null, named_struct('start', cast(null as int), 'end', 3, 'replacement', 'q')) as edits")
    got = token_counts.apply_edits(token_counts.build(docs, vocabulary), vocabulary).collect()
    count = vocabulary.counter()
    assert len(got) == len(awkward.rows()) and all(r.n_tokens == count(r.text or "") for r in got)
    long = next(r for r in got if r.doc_id == 10)
    assert long.n_edits == 1 and long.reencoded_chars < 4000 < len(long.text) and long.text[50:53] == "X Y"
    empty = awkward.empty(spark).selectExpr("*", f"cast(array() as {token_counts.EDITS}) as edits")
    assert token_counts.apply_edits(token_counts.build(empty, vocabulary), vocabulary).collect() == []


# --- decontamination ----------------------------------------------------------------------------
def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_recall_against_brute_force():
    rnd = random.Random(8)
    vocab = [f"w{rnd.randrange(500)}" for _ in range(2000)]
    items = [(i, [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 6, 9, 15, 30, 50]))]) for i in range(60)]
    limits = decontaminate.Limits()
    built = decontaminate.Items([(i, " ".join(w)) for i, w in items], limits)
    docs = []
    for _ in range(150):
        words = list(rnd.choice(items)[1])
        for _ in range(rnd.randrange(int(0.25 * len(words)) + 1)):
            at, how = rnd.randrange(len(words)), rnd.random()
            words[at:at + 1] = [rnd.choice(vocab)] if how < 0.5 else [] if how < 0.75 and len(words) > 1 else [words[at], rnd.choice(vocab)]
        before = [rnd.choice(vocab) for _ in range(rnd.randrange(60))]
        docs.append(before + words + [rnd.choice(vocab) for _ in range(rnd.randrange(60))])
    found = built.matches(pa.array([" ".join(d) for d in docs]))
    want = {(d, i): e for d, doc in enumerate(docs) for i, w in items if (e := fewest_edits(w, doc)) <= limits.most(len(w))}
    got = {(d, int(built.ids[i])): e for d, m in enumerate(found) for i, e in m.items()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[k] == want[k] for k in got)


def test_awkward_decontamination(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Same line"), (2, None), (3, ""), (None, "one"), (4, "same, LINE"), (5, "a b c d")], "item_id long, text string")
    for block in (20_000, 2):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
        got = {r.doc_id: r.item_ids for r in decontaminate.find_items(awkward.frame(spark), items).collect()}
        assert got[13] == [1, 4] and got[11] == got[12] == [5] and got[5] == [] and got[1] == []
    clean = decontaminate.clean_documents(awkward.frame(spark), items)
    assert clean.columns == awkward.frame(spark).columns and {r.item_ids for r in clean.collect()} == {"x"} and clean.count() == len(awkward.rows()) - 3
    assert decontaminate.find_items(awkward.frame(spark), items.filter("item_id > 9")).count() == len(awkward.rows())
    assert decontaminate.find_items(awkward.empty(spark), items).collect() == []
