import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toroid.llm import pu, quality, token_counts, toxicity, url_filter
from toroid.llm.chat import digests, escape, format_chats, parse_turns, unescape
from toroid.llm.language import PENALTY, LanguageModel, identify, learn
from toroid.llm.token_counts import PrefixCounter, _default_path, count_tokens, counter, fits, longest_prefix
from toroid.llm.url_filter import Rule, host_and_path, judge, lexical, matching_rule

PARTS = ["a", "B", "'", "re", "ll", " ", "  ", "\n", "\t", "1", "²", "½", "é", "ß", "…", "“", "漢", "!", "-", "_", "<|", "<|endoftext|>", "|>", "\x1c", "\u2003", "\xa0", "ª", "٣", "👍", "'s", "don't"]


@settings(max_examples=150, deadline=None)
@example("\n\na")
@example("a\n\nb")
@example("para one.\n\npara two\n\n\n  third don't\t\tlast \n x")
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_every_prefix_is_counted_as_the_library_does(text):
    own = counter(_default_path())
    (ends, counts), = own.count([text])

    def library(t):
        return len(own.tokenizer.encode(t, add_special_tokens=False).ids)

    assert (counts[-1] if counts else 0) == library(text)
    assert own.every_prefix(text) == [library(text[:n]) for n in range(len(text) + 1)]
    for n in range(len(text) + 2):
        assert own.at(text, ends, counts, n) == library(text[:n])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinorst thgé漢=/+0-"), max_size=40))
def test_cuts_call_no_encoder(text):
    own = counter(_default_path())
    (ends, counts), = own.count([text])
    wanted = [len(own.tokenizer.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
    held, own.tokenizer = own.tokenizer, None if text.isascii() else own.tokenizer
    try:
        assert [own.at(text, ends, counts, n) for n in range(len(text) + 1)] == wanted
    finally:
        own.tokenizer = held


def test_long_pieces_and_small_memory(monkeypatch):
    own = PrefixCounter(_default_path())
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (300, 5000, 40, 41, 42)] + ["=" * 3000, " " * 3000 + "x"]
    wanted = [len(own.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 400)
    assert [c[-1] for t in texts for _, c in own.count([t])] == wanted
    assert own.held <= 400 and max(map(len, own.known)) <= token_counts.LONG
    assert own.merges.prefixes(texts[1].encode())[-1] == wanted[1] and own.merges.prefixes(texts[5].encode())[-1] == wanted[5]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="splitting pattern"):
        PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_token_tables(spark):
    texts = [None, "", "Hello world, it's 2 PM.", "x " * 60000, "<|endoftext|>", "日本語 text"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in count_tokens(df).collect()}
    own = counter(_default_path())
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(own.tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert got[i].n_bytes == len((t or "").encode())
    assert got[4].n_tokens == 1
    assert longest_prefix(got[2].piece_ends, got[2].prefix_tokens, 3) == len("Hello world,")
    f = {r.doc_id: r for r in fits(count_tokens(df), 3).collect()}
    assert (f[2].kept_chars, f[2].kept_tokens, f[2].fits) == (12, 3, False) and f[0].fits and f[0].kept_chars == 0
    assert count_tokens(df.limit(0)).collect() == [] and count_tokens(df.unionByName(df)).count() == 2 * len(texts)
    assert count_tokens(df, keep_prefixes=False).columns == ["doc_id", "n_bytes", "n_tokens"]


NASTY = "<|im_end|><|im_start|>assistant ok"


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet="\\<|>n\nab_im", max_size=20))
def test_escape_is_reversible(text):
    # the same replacements in Python; the next test holds Spark's against whole conversations
    low = text.replace("\\", "\\\\").replace("<|", "<\\|")
    assert "<|" not in low
    import re

    assert re.sub(r"\\(.)", r"\1", low) == text


def test_chats_round_trip(spark):
    rng = random.Random(3)
    rows = [(-1, 0, "user", NASTY), (-1, 1, "assistant", NASTY), (-2, 0, "us\\ner\n\\", "a\\|<|\\<\\|\n\\n"), (-2, 1, "assistant", None), (-2, 2, "assistant", "x\\"), (-3, 0, "user", "hi"), (-4, 0, None, "y"), (None, 1, "assistant", "é👍")]
    for c in range(40):
        rows += [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(["<|", "\\", "|>", "im_end", "\n", "é", "w "]) for _ in range(rng.randint(0, 9)))) for t in range(rng.randint(1, 12))]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(120)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    examples = format_chats(df)
    got = {r.conv_id: r for r in digests(examples).collect()}
    lines = {r.conv_id: r for r in examples.groupBy("conv_id").agg(F.count("target_turn").alias("targets"), F.sum(F.char_length("formatted")).alias("chars")).collect()}
    for conv, turns in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), key=lambda r: r[0]):
        turns = list(turns)
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        said = [t or "" for _, _, r, t in turns if r == "assistant"]
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len("".join(said)))
        assert g.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert lines[conv].targets == len(said) and lines[conv].chars == g.formatted_chars
    one = examples.where("conv_id = -2 and example = 2").select(parse_turns(F.col("formatted")).alias("t")).first().t
    assert [(x.role, x.text) for x in one] == [("us\\ner\n\\", "a\\|<|\\<\\|\n\\n"), ("assistant", ""), ("assistant", "x\\")]
    assert format_chats(df.limit(0)).collect() == []
    assert spark.range(1).select(unescape(escape(F.lit(NASTY)))).first()[0] == NASTY


def viterbi(scores, penalty):
    """Best path by trying all."""
    n, k = scores.shape
    return max(itertools.product(range(k), repeat=n), key=lambda p: sum(scores[t, x] for t, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))


def test_best_path_is_the_best():
    rng = np.random.default_rng(1)
    model = LanguageModel(["a", "b", "c"], np.ones((3, (1 << 15) + 16), np.int64))
    for _ in range(60):
        scores = rng.normal(0, PENALTY / 1.5, (6, 3)).astype(np.float32)
        cost = lambda p: sum(scores[t, x] for t, x in enumerate(p)) - PENALTY * sum(a != b for a, b in zip(p, p[1:]))
        assert cost(model.best_path(scores)) == pytest.approx(cost(viterbi(scores, PENALTY)), abs=1e-3)


def test_languages_and_spans(spark):
    rng = random.Random(1)
    own = {"aa": "the of and thing water over under".split(), "bb": "der die und nicht über unter wasser".split(), "ru": "вода над под земля море".split()}
    say = lambda k, n: " ".join(rng.choice(own[k]) for _ in range(n))
    rows = [(i, say(k, 40), k, "x") for i, k in enumerate(list(own) * 20)] + [(900, say("aa", 3), None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = learn(df)
    assert model.langs == ["aa", "bb", "ru"]
    mixed = say("aa", 60) + " " + say("ru", 50)
    cases = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 🙂"), (4, say("bb", 30)), (5, mixed), (6, say("ru", 5)), (7, "the " * 60000), (4, "und")], "doc_id long, text string")
    got = identify(cases, model).collect()
    by = {r.doc_id: r for r in got if not (r.doc_id == 4 and r.spans[0].end < 10)}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == "bb" and by[6].lang_pred == "ru" and by[7].lang_pred == "aa"
    assert [s.lang for s in by[5].spans] == ["aa", "ru"] and by[5].spans[0].end <= by[5].spans[1].start == len(mixed) - len(mixed.split(" ", 60)[60])
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 8
    assert identify(cases, learn(df.limit(0))).first().lang_pred == "und"
    assert identify(cases.limit(0), model).collect() == []


def test_risk_never_rewards_negative_losses():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    x = rng.normal(0, 1, (3000, 2)) + np.outer(y, [2.5, 0])
    known = y & (rng.random(3000) < 0.4)
    model = pu.fit(x, known, 0.3)
    assert ((model.score(x) > 0.5) == y).mean() > 0.85
    assert np.isfinite(model.weights).all()
    none = pu.fit(x, np.zeros(3000, bool), 0.3)
    assert none.score(x) == pytest.approx(np.full(3000, 0.3))


def good_text(rng, n=80):
    return " ".join(rng.choice("the of a water stone bird over under light house".split()) for _ in range(n)).capitalize() + "."


def labelled(spark, n=300):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        text = good_text(rng)
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            text = text.upper().replace(" ", "!! ")
        if toxic:
            text += " you scumling and you scumheap idiot"
        docs.append((i, text, "en", "s", 1.0))
        if i % 4:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, None, None, 1.0), (n + 1, "", "en", "s", 1.0), (n + 2, good_text(rng, 40000), "en", "s", 1.0), (0, docs[0][1], "en", "s", 1.0)]
    labels += [(1, None, None), (5, 0, 0), (10**6, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.learn(docs, labels)
    rows = docs.select("doc_id", quality.quality_score(model, F.col("text")).alias("s")).collect()
    assert len(rows) == 304 and all(0 <= r.s <= 1 for r in rows)
    right = sum((r.s >= 0.3) == (r.doc_id % 5 != 0) for r in rows if r.doc_id < 300)
    assert right >= 295
    assert docs.limit(0).select(quality.quality_score(model, F.col("text"))).collect() == []
    flat = quality.learn(docs.limit(0), labels.limit(0))
    assert flat.score([b"x", None]) == pytest.approx([0.5, 0.5])


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels)
    rows = docs.select("doc_id", toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()
    assert len(rows) == 304 and all(0 <= r.s <= 1 for r in rows)
    assert all((r.s >= 0.5) == (r.doc_id % 7 == 0) for r in rows if r.doc_id < 300)
    assert max(r.s for r in rows if r.doc_id >= 300) < 0.5
    assert "idiot" in model.vocabulary and "water" not in model.vocabulary
    flat = toxicity.learn(docs.limit(0), labels.limit(0))
    assert flat.score(["x", None]) == pytest.approx([0.5, 0.5])


def test_lookup_finds_what_words_lists():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(200)) for _ in range(5)] + [None, ""]
    numbers = {w: i for i, w in enumerate(sorted(set().union(*map(toxicity.words, texts[:3]))))}
    lookup = toxicity.Lookup(numbers)
    for t in texts:
        assert lookup.present(t) == sorted(numbers[w] for w, n in toxicity.words(t).items() if w in numbers for _ in range(n))
    assert toxicity.features([[0, 2, 2, 2], []], 3).tolist() == [[1, 0, 2], [0, 0, 0]]


def test_counts_come_from_the_merges_and_equal_the_library():
    rng = random.Random(5)
    own = PrefixCounter(_default_path())
    texts = ["".join(rng.choice(["the", " a", "Zähl", " ", "\n", "  ", "12", "'s", "é", "日本", "!?", "zz", "qx", "<|endoftext|>", "\u0301", "😀"]) for _ in range(60)) for _ in range(300)]
    texts += ["a" * 3000, " " * 3000, "=-" * 700, "".join(rng.choice("abcXYZ") for _ in range(5000)), ""]
    want = [len(e) for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    class Refusing:
        pre_tokenizer = own.tokenizer.pre_tokenizer

    own.tokenizer = Refusing()  # has no way to encode
    assert [c[-1] if c else 0 for _, c in own.count(texts)] == want


def test_urls(spark):
    cases = {
        "https://A.Example.COM/en/7?x#y": ("a.example.com", "/en/7", "example.com/en/7"), "http://com/en/": ("com", "/en/", "com/en/"), "http://xcom/en/": ("xcom", "/en/", None), "no scheme": ("", "", None), None: ("", "", None),
        "x://h?q=/en/": ("h", "", None), "x://h#f": ("h", "", None), "http://b.net/de/8": ("b.net", "/de/8", "net/de/"), "http://b.example.net/de/81?": ("b.example.net", "/de/81", "example.net/de/8"), "": ("", "", None), "http://a.org/es": ("a.org", "/es", None),
        "É://É.ORG/es/": ("É.org", "/es/", "org/es/"), "http://h.com/en/" + "x" * 20000: ("h.com", "/en/" + "x" * 20000, "com/en/"), "a://b://c/d": ("b:", "//c/d", None), "http://a.com\n/en/": ("a.com\n", "/en/", None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    host, path = host_and_path(F.col("url"))
    got = df.select("url", host.alias("host"), path.alias("path")).withColumn("rule", matching_rule(F.col("host"), F.col("path"))).collect()
    assert {r.url: (r.host, r.path, r.rule) for r in got} == cases
    assert lexical(df.withColumn("host", host).withColumn("path", path)).count() == len(cases)


def test_judge(spark):
    rng = random.Random(4)
    rows = [(i, f"https://h{i % 9}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(9999)}", "<html>", 1) for i in range(400)]
    rows += [(7, rows[7][1], "", 1), (900, None, "", 1), (901, "", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, label int")
    got = judge(df).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    verdicts = {r.text: r.verdict for r in (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "block"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)
    assert {r.page_id for r in got if r.block_score is not None} == {r.page_id for r in got if r.rule is None}
    assert judge(df.limit(0)).collect() == []
    only = judge(df, rules=(Rule("org", "/es/", "block"),)).collect()
    assert {r.verdict for r in only} == {"block"}
    assert {r.verdict for r in judge(df, rules=()).collect()} == {"allow"}


def test_rules_say_what_the_contract_says(spark):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://b.net/de/8", "http://b.example.net/de/81", "http://a.org/es/"]
    got = judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == list(want.items())


def test_rule_ties(spark):
    rules = (Rule("b.c", "/x", "allow"), Rule("c", "/x/y", "block"))  # the texts are "b.c/x" and "c/x/y", of one length
    df = spark.createDataFrame([("b.c", "/x/yz"), ("c", "/x/y"), ("b.c", "/x")], "host string, path string")
    for order in (rules, rules[::-1]):
        got = [r[0] for r in df.select(matching_rule(F.col("host"), F.col("path"), order)).collect()]
        assert got == [order[0].text, "c/x/y", "b.c/x"]


def test_unseen_urls_are_judged_by_what_they_look_like(spark):
    """Held-out accuracy: a fifth of the urls that rules decide is judged without them."""
    rng = random.Random(11)
    spam = [f"http://{rng.choice('abcdefgh')}{i}.shop{rng.randrange(30)}.test/{'-'.join(str(rng.randrange(10**6)) for _ in range(3))}?ref={i}&x=1" for i in range(500)]
    good = [f"https://www.site{rng.randrange(30)}.test/{rng.choice(['news', 'sport', 'about'])}/{rng.choice('abcdefgh')}{i}" for i in range(60)]
    hidden = {u for i, u in enumerate(spam + good) if i % 5 == 0}
    def shown(u):
        return u.replace(".test/", ".spam/" if u in spam else ".fine/") if u not in hidden else u
    rows = [(i, shown(u)) for i, u in enumerate(spam + good)] + [(10**6, shown(spam[1]))] * 300
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), rules=(Rule("spam", "/", "block"), Rule("fine", "/", "allow"))).where("rule is null").collect()
    right = [(r.verdict == "block") == (spam[0][:5] == "http:" and r.page_id < 500) for r in got]
    assert len(got) == len(hidden) and sum(right) >= 0.95 * len(right)


def test_own_label_is_not_among_the_features(spark):
    df = spark.createDataFrame([(f"u{i}", "s", "d", float(i % 2), 0) for i in range(40)] + [("lone", "t", "t", 1.0, 0)], "url string, suffix string, domain string, label double, other int")
    got = url_filter.training_urls(df, {k: url_filter._counts(df, k) for k in ("suffix", "domain")}, 30).collect()
    lone = next(r for r in got if r.url == "lone")
    assert (lone.suffix_rate, lone.suffix_urls) == (0.5, 0.0)
    assert {k: sum(r.weight for r in got if r.label == k) for k in (0.0, 1.0)} == pytest.approx({0.0: len(got) / 2, 1.0: len(got) / 2})


def test_trees_learn_what_urls_look_like(spark):
    rules = (Rule("bad.example", "/", "block"), Rule("good.example", "/", "allow"))
    rows = [(i, f"http://w{i}.bad.example/{'9' * 30}?a=1&b=2&c={i}") for i in range(200)] + [(1000 + i, f"http://w{i}.good.example/news") for i in range(200)]
    rows += [(5000, "http://w1.other.test/" + "8" * 30 + "?a=3&b=4&c=5"), (5001, "http://w1.other.test/news")]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got[5000].verdict == "block" and got[5001].verdict == "allow"


#: A lambda, so that workers need not import this module.
dense = lambda x: np.stack(x.to_numpy()).astype(float) if len(x) else np.empty((0, 2))


def samples(spark, x, positive):
    return spark.createDataFrame([(i, a.tolist(), bool(k)) for i, (a, k) in enumerate(zip(x, positive))], "id long, x array<double>, positive boolean")


def auc(scores, y):
    rank = np.argsort(np.argsort(scores)) + 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_rare_positives_reach_every_shard(spark):
    rng = np.random.default_rng(3)
    y = np.arange(4000) % 500 == 0
    x = rng.normal(0, 1, (4000, 2)) + np.outer(y, [6, 0])
    rows = samples(spark, x, y)
    whole = pu.fit(x, y, 0.01)
    dealt = pu.fit_shards(rows, dense, 2, 0.01, shard=100)
    assert dealt.weights[0] > 0.8 * whole.weights[0]
    assert (dealt.score(x[y]) > 0.5).sum() == (whole.score(x[y]) > 0.5).sum() > 0
    none = pu.fit_shards(rows.where("not positive"), dense, 2, 0.01, shard=100)
    assert none.score(x[:9]) == pytest.approx(np.full(9, 0.01))


def test_ten_times_the_web_with_the_same_positives(spark):
    found = []
    for n in (3000, 30_000):
        rng = np.random.default_rng(4)
        y = rng.random(n) < 0.3
        x = rng.normal(0, 1, (n, 2)) + np.outer(y, [3, 0])
        known = np.zeros(n, bool)
        known[np.flatnonzero(y)[:50]] = True
        model = pu.fit_shards(samples(spark, x, known), dense, 2, 0.3, shard=512)
        found.append((auc(model.score(x), y), (model.score(x[~y]) < 0.5).mean()))
    assert min(f[0] for f in found) > 0.97 and found[1][1] == pytest.approx(found[0][1], abs=0.03)


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.85])
def test_prior_comes_from_positives_and_unlabelled_rows(spark, prior):
    rng = np.random.default_rng(5)
    y = rng.random(12_000) < prior
    x = rng.normal(0, 1, (12_000, 2)) + np.outer(y, [4, 0])
    known = y & (rng.random(12_000) < 0.3)
    assert pu.estimate_prior(samples(spark, x, known), dense, 2) == pytest.approx(prior, abs=0.05)


def test_prior_without_rows_or_positives(spark):
    rows = samples(spark, np.zeros((5, 2)), np.zeros(5, bool))
    assert pu.estimate_prior(rows, dense, 2) == pu.estimate_prior(rows.limit(0), dense, 2) == 0.5


def test_classifiers_with_null_ids_and_clashing_names(spark):
    docs, labels = labelled(spark, 100)
    odd = docs.unionByName(spark.createDataFrame([(None, "a b", "en", "s", 1.0)], docs.schema)).withColumns({"positive": F.lit("p"), "x": F.lit("x"), "label": F.lit(3), "id": F.lit("i")})
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1)], labels.schema)).withColumn("positive", F.lit("p"))
    for module in (quality, toxicity):
        plain, same = module.learn(docs.unionByName(odd.where("doc_id is null").select(docs.columns)), labels, prior=0.4), module.learn(odd, more, prior=0.4)
        assert plain.prior == same.prior == 0.4 and same.linear.weights == pytest.approx(plain.linear.weights, abs=1e-6)
