import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tallyreef.llm import common, language_id, mixing, near_dedup, quality_rules, secret_scan
from tests.llm import plain


def test_op6_equals_plain(spark, sf, docs):
    found = {r.doc_id: r for r in secret_scan.op6_secret_scan(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        spans = plain.base_spans(r.text)
        x = found[r.doc_id]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        told = [f"{k}:{s}:{e}" for k, s, e in spans]
        assert x.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(x.spans.split(",")) if told else True


def test_guess_cost_segments_known_parts():
    cost = secret_scan.model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    total, parts = cost.segments("password2019")
    assert [k for k, _, _ in parts] == ["word", "date"] and total < 8
    assert cost.segments("qwertyuiop")[1][0][0] in ("walk", "word") and cost.segments("aaaaaaaaaaaa")[1] == [("repeat", 0, 12)]
    assert cost.segments("k9#Vq2!zLw8$Xr")[0] > 12 and cost.segments("")[0] == 0


def test_guess_cost_is_least():
    """Against all segmentations of short values."""
    cost = secret_scan.model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    draw = random.Random(7)
    parts = ("123", "qwe", "aaa", "1999", "19990101", "abab", "dog", "Pass", "x#", "0", "asdf", "zz", "ababab", "2020-01-02", "p4ss", "31/12/1999", "abcabcabc")
    values = ["12319990101", "", "a"] + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 5)))[:18] for _ in range(250)]
    for value in values:
        total, found = cost.segments(value)
        assert abs(total - plain.least_guesses(cost, value, secret_scan.LONGEST_UNIT, secret_scan._DATE, secret_scan._STAND_INS)) < 1e-9, value
        assert "".join(value[i:j] for _, i, j in found) == value
    assert cost.segments("12319990101")[0] < 8.61


def test_guess_cost_of_long_runs():
    """Few starts of a span are kept, so a long value takes no square of its length."""
    cost = secret_scan.model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    began = time.perf_counter()
    assert cost.segments("a" * 50_000)[1][-1][0] == "repeat" and abs(cost.segments("qwerty" * 8_000)[0] - 6 - math.log10(8_000)) < 1e-9
    assert time.perf_counter() - began < 20


def cleaned(text):
    base = secret_scan.base_spans(text)
    guessed = secret_scan.guessed_spans(secret_scan.guesses(text, secret_scan.model(public_tokenizers.path("byte_bpe_50k.tiktoken"))))
    return secret_scan.redacted(text, sorted([*base, *guessed], key=lambda s: s[1]))


def test_guess_reaches_past_a_base_span():
    assert cleaned("a password=abc123$Xy9#Lm2&Qr b") == "a [secret] b"
    assert cleaned('{"token": "abcdef!9#Lm2&Qr%4"}') == '{"[secret]"}'
    text = "password=k9Vq2zLw8Xr4 b"
    base = secret_scan.base_spans(text)
    values = secret_scan.guesses(text, secret_scan.model(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert base == [("assign", 0, 21)] and [v[:2] for v in values] == [(9, 21)] and secret_scan.guessed_spans(values) == [("guess", 9, 21)]


def test_values_of_the_tables_have_their_least_cost(spark, sf):
    """Every value in a credential context of a table, most of them within base spans, against all segmentations."""
    cost = secret_scan.model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").filter("text rlike '(?i)pass|pwd|secret|token|key|auth|bearer|basic|credential'").collect()]
    found = [(t[a:b], c) for t in texts for a, b, c in secret_scan.guesses(t, cost)]
    assert found
    for value, total in found:
        assert abs(total - plain.least_guesses(cost, value, secret_scan.LONGEST_UNIT, secret_scan._DATE, secret_scan._STAND_INS)) < 1e-9, value


def test_guess_of_eight_and_nine_characters():
    for value in ("xK9#mQ2$", "$k9#mQ2p", "$k9#mQ2p%"):
        assert cleaned(f"pwd: {value} b") == "pwd: [secret] b" and cleaned(f"passphrase is {value}.") == "passphrase is [secret]."
    for value in ("password", "summer2019", "qwertyuiop", "aaaaaaaa"):
        assert cleaned(f"pwd: {value} b") == f"pwd: {value} b"


def test_secrets_on_odd_rows(odd, nothing):
    found = {(r.doc_id, (r.text or "")[:4]): r.secrets_ for r in secret_scan.scan(odd).collect()}
    assert found[1, ""].spans == "" and found[11, "pass"].n_assign == 1 and found[11, "pass"].n_access == 1
    clean = {r.doc_id: r for r in secret_scan.redact(odd).collect()}
    assert secret_scan.redact(odd).columns == odd.columns and clean[11].secrets == 2
    assert clean[11].text == "[secret] é [secret]" and clean[11].n_chars == len(clean[11].text) and clean[1].text is None
    assert secret_scan.scan(nothing).count() == 0


def test_op7_targets_and_bounds(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = mixing.op7_mixing(spark, d).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    taken, target, sizes = Counter(), {}, Counter()
    for r in rows:
        size = len(plain.WORD.findall(texts[r.doc_id].text or ""))
        assert r.size == size and 0 <= r.taken <= 3 * size
        source = texts[r.doc_id].source
        taken[source] += r.taken
        sizes[source] += size
        target[source] = r.target
    # Targets by the rule: weights 5, 2, 1 by code point, capped at 3 times the size, the excess reshared.
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        wanted = 3 * sizes[s] if s in capped else share[s]
        assert abs(target[s] - wanted) < 1e-6 * wanted + 1e-6 and abs(taken[s] - wanted) <= 0.02 * wanted
    assert sorted(rows) == sorted(mixing.op7_mixing(spark, d).collect())


def test_apportion_equals_plain_sainte_lague(spark):
    weights = [53.0, 24.0, 23.0, 7.5, 0.0]
    items = spark.createDataFrame([(0, k, w, 31, 40) for k, w in enumerate(weights)], "g int, k int, w double, seats long, most long")
    found = {r.k: r.quota for r in mixing.apportion(items, "g", "k", "w", "seats", "most").collect()}
    seats = Counter()
    for _ in range(31):
        seats[max(range(5), key=lambda k: (weights[k] / (2 * seats[k] + 1), -k))] += 1
    assert found == {k: seats[k] for k in range(5)}


def test_apportion_with_ties_and_few_places(spark):
    cases = [([4.0] * 9, 13, 3), ([1.0, 2.0, 3.0], 100, 5), ([0.0, 0.0], 4, 9), ([7.0, 7.0, 1.0], 0, 9), ([10.0, 5.0, 2.5, 2.5], 10, 4)]
    rows = [(g, k, w, n, most) for g, (weights, n, most) in enumerate(cases) for k, w in enumerate(weights)]
    found = {(r.g, r.k): r.quota for r in mixing.apportion(spark.createDataFrame(rows, "g int, k int, w double, seats long, most long"), "g", "k", "w", "seats", "most").collect()}
    for g, (weights, n, most) in enumerate(cases):
        assert [found[g, k] for k in range(len(weights))] == plain.sainte_lague(weights, n, [most] * len(weights))


def test_shard_quotas_equal_plain_sainte_lague(spark):
    draw = random.Random(2)
    cases = []
    for i in range(60):
        block = draw.choice((1, 4, 2048))
        size = draw.randint(1, 64 * block * draw.randint(1, 5))
        blocks = -(-size // block)
        cases.append((i, size, block, blocks, draw.randint(0, 3 * blocks)))
    df = mixing.with_shards(spark.createDataFrame(cases, "id int, source_size long, block long, blocks long, quota long"))
    shard = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / 64))).alias("shard")
    found = {(r.id, r.shard): r.q for r in df.select("*", shard).select("id", "shard", mixing._shard_quota(F.col("shard")).alias("q")).collect()}
    for i, size, block, blocks, quota in cases:
        words = [min(size, (s + 1) * 64 * block) - s * 64 * block for s in range(-(-blocks // 64))]
        most = [3 * min(64, blocks - 64 * s) for s in range(len(words))]
        assert [found[i, s] for s in range(len(words))] == plain.sainte_lague(words, quota, most), (size, block, quota)


def test_a_small_source_changes_no_other_block(spark):
    """Without and with a source of three words: the large source's runs are as long, and the small one comes near its target."""
    large = [(i, " ".join(["w"] * 3000), "a") for i in range(600)]
    cuts = []
    for rows in (large, [*large, (1000, "x y z", "b")]):
        found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        cuts.append(sum(len(r.takes) for r in found if r.source_size > 3))
        assert all(r.taken == r.target == 9 for r in found if r.source_size == 3)
    assert cuts[0] == cuts[1] < 2000


def test_running_sum(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("v")).repartition(7)
    found = sorted(tuple(r) for r in mixing.running_sum(df, ["k"], "v", "before").select("k", "v", "before").collect())
    total = 0
    for _, v, before in found:
        assert before == total
        total += v


def test_many_equal_rows_are_mixed(spark):
    rows = [(None, "one two three four five", "a", 23)] * 3000 + [(1, " ".join(["w"] * 500), "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = mixing.materialize(docs)
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source_size] += r.taken
    assert words["a"] == taken[15_000] and words["b"] == taken[500] == 1500


def test_mixing_on_odd_rows(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 14 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix(nothing).count() == 0 == mixing.materialize(nothing).count()
    assert mixing.materialize(odd).columns == odd.columns


def test_op8_held_out(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = language_id.op8_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in rows) / len(rows)
    print("held-out accuracy", right, len(rows))
    assert right >= 0.9


def test_unlearned_scripts_count_for_none(spark):
    rows = [(1, "the cat sat on the mat " * 30, "en"), (2, "der Hund und die Katze sind im Haus " * 40, "de")]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    hebrew = "שלום"
    found = language_id.labelled_texts([hebrew * 5, f"{hebrew} the cat on the mat", None, "1 2", "the dog"], model)
    assert found[0] == ("de", 0.0, [{"start": 0, "words": 1, "lang": "und"}])  # more letters of de are learned
    lang, score, spans = found[1]
    assert lang == "en" and score == 14 / 18 and spans == [{"start": 0, "words": 1, "lang": "und"}, {"start": 1, "words": 5, "lang": "en"}]
    assert found[2] == found[3] == ("und", 0.0, []) and found[4][:2] == ("en", 1.0)


def test_spans_equal_plain(spark, sf):
    """Scores of words, spans and language of mixed texts against one word and one trigram at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs)
    texts = [r.text for r in docs.filter("text is not null").limit(60).collect()]
    mixed = ["".join((a or "")[:120] + " γάτα " + (b or "")[:90]) for a, b in zip(texts, texts[7:], strict=False)]
    for text, (lang, score, spans) in zip(mixed, language_id.labelled_texts(mixed, model), strict=True):
        expected = plain.spans(text, model, language_id)
        assert [(s["start"], s["words"], s["lang"]) for s in spans] == expected[2]
        assert lang == expected[0] and abs(score - expected[1]) < 1e-12


def test_long_texts_keep_their_precision(spark):
    """A million English words and a few German ones at the end: the same labels as for a thousand."""
    rows = [(1, "the cat sat on the mat and looked at a dog " * 30, "en"), (2, "der Hund und die Katze sind nicht im Haus gewesen " * 30, "de")]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for n in (100, 200_000):
        text = "the cat sat on the " * n + "der Hund und die Katze sind nicht"
        assert [(s["words"], s["lang"]) for s in language_id.labelled_texts([text, "the cat"], model)[0][2]] == [(5 * n, "en"), (7, "de")]


def test_viterbi_equals_plain():
    import numpy as np

    draw = np.random.default_rng(5)
    counts = np.array([1, 130, 0, 64, 5])
    scores = draw.normal(0, 6, (counts.sum(), 3)).astype(np.float32)
    labels = language_id.label_words(scores, counts)

    def worth(path, s):
        return sum(s[i, k] for i, k in enumerate(path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))

    at = 0
    for n in counts:
        s = scores[at : at + n].astype(float)
        best = np.zeros(3)
        for i in range(n):
            best = (np.maximum(best, best.max() - language_id.SWITCH) if i else best) + s[i]
        if n:
            assert abs(worth(labels[at : at + n].tolist(), s) - best.max()) < 1e-2
        at += n


def test_language_of_mixed_text(spark, odd, nothing):
    english, greek = "the cat sat on the mat and looked at the dog " * 30, "η γατα κάθισε στο χαλί " * 30
    model = language_id.learn(spark.createDataFrame([(1, english, "en"), (2, greek, "el")], "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, "the cat and the dog " + greek[:60]), (2, None), (3, "123 !"), (4, "")], "doc_id long, text string")
    found = {r.doc_id: r.language for r in language_id.identify(mixed, model).collect()}
    assert [s.lang for s in found[1].spans] == ["en", "el"] and found[1].lang_pred == "el"
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (2, 3, 4))
    assert language_id.identify(odd, model).count() == 14
    empty = language_id.learn(nothing)
    assert {r.language_.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_op9_equals_plain(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.op9_near_dedup(spark, sf).collect())
    assert found == sorted(plain.components(rows, 4))


def test_op9_equals_plain_on_more_rows(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.op9_near_dedup(spark, d).collect())
    assert found == sorted(plain.components(rows, 4))


def test_remaining_groups_are_joined(spark):
    """Two families of near-copies around one text each, whose bands meet; only some members of the families are near."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(120)]

    def changed(words, n):
        out = list(words)
        for i in draw.sample(range(len(out)), n):
            out[i] = f"x{draw.random()}"
        return out

    other = changed(base, 5)
    rows = [(i, " ".join(changed(base if i % 2 else other, draw.randint(0, 3)))) for i in range(120)]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect())
    assert found == sorted(plain.components(rows, 4))


def test_keep_one_keeps_rows(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, b, "s"), (5, a, "s"), (5, b, "s"), (None, a, "t"), (None, "c d e f g h", "t"), (None, "c d e f g h", "t"), (7, "", "u"), (7, "", "u"), (9, None, "u"), (3, b.upper(), "r")]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter((r.doc_id, (r.text or "").lower()) for r in kept) == Counter([(3, b), (5, a), (None, "c d e f g h"), (7, ""), (7, ""), (9, "")])
    again = near_dedup.keep_one(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(3)).collect()
    assert Counter(map(tuple, kept)) == Counter(map(tuple, again))


def test_dedup_chain_of_links(spark):
    """Neighbours are near, ends are not; copies in capitals; a group whose leader links none of its chain's end."""
    words = [f"w{i}" for i in range(140)]
    rows = [(100 - i, " ".join(words[4 * i : 4 * i + 100])) for i in range(10)] + [(3, " ".join(words[:100]).upper()), (200, "a b"), (201, "A B"), (202, "a b c")]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect())
    assert found == sorted(plain.components(rows, 4))
    assert len({c for i, _, c in found if i < 150}) == 1


def test_dedup_on_odd_rows(odd, nothing):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == 14
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.component_id)
    assert by[4] == by[5] == {4} and by[1] == {1} and by[2] == {2} and by[3] == {3} and by[None] == {None}
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_pipeline_equals_plain(spark, sf, docs):
    frames, at = [], docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        at = at.persist()
        frames.append(at)
    names = docs.columns
    assert all(f.columns == names for f in frames[:-1])
    kept = [r for r in docs.collect() if quality_rules.verdict(quality_rules.Text(r.text), list(quality_rules.RULES))]
    assert sorted(r.doc_id for r in frames[0].collect()) == sorted(r.doc_id for r in kept)
    heads = plain.components([(r.doc_id, r.text) for r in kept], 5)
    single = [r for r, (i, _, c) in zip(kept, heads, strict=True) if i == c]
    assert sorted(r.doc_id for r in frames[1].collect()) == sorted(r.doc_id for r in single)
    safe = {r.doc_id: r.text for r in frames[2].collect()}
    assert set(safe) == {r.doc_id for r in single}
    for r in single:
        spans = plain.base_spans(r.text)
        if not spans and "[secret]" not in safe[r.doc_id]:
            assert safe[r.doc_id] == r.text
        assert not plain.base_spans(safe[r.doc_id])
    plan = {r.doc_id: r.taken for r in mixing.mix(frames[2]).collect()}
    words = Counter()
    for r in frames[3].collect():
        words[r.doc_id] += len(plain.WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    sources = {r.doc_id: r.source for r in frames[2].collect()}
    by = [Counter(), Counter()]
    for i, n in plan.items():
        by[0][sources[i]] += n
        by[1][sources[i]] += words[i]
    assert by[0] == by[1]
    other = plain.tiktoken_of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    expected = Counter((r.doc_id, tuple(other.encode_ordinary(r.text))) for r in frames[3].collect())
    assert expected == Counter((r.doc_id, tuple(r.ids)) for r in frames[4].collect())
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()
    assert Counter(whole) == Counter(frames[4].select("doc_id", "ids_sha256").collect())


def test_pipeline_on_odd_rows(spark, odd, nothing):
    """Stages keep all columns, clashing ones too; rules drop rows without enough words, and copies leave one."""
    for docs in (odd, nothing):
        at = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = common.written(stage(spark, at, ""), "odd-stage")
            assert set(docs.columns) <= set(at.columns)
            assert at.filter("quality <> 'q' or secrets <> 2 or language <> 3 or size <> 1 or key <> 'k' or ids <> 4").count() == 0
        assert {r.doc_id for r in at.collect()} <= ({4, 6} if docs is odd else set()) | {None}
        out = corpus_pipeline.STAGES[-1][1](spark, at, "")
        assert out.count() == at.count() and out.filter(F.col("doc_id") == 1).count() == 0


def test_pipeline_decodes_what_it_encodes(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    found = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.encode(spark, docs, "").collect())
    assert found == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
