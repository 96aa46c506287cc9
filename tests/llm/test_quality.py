from itertools import permutations

from pyspark.sql import functions as F

from tallyreef.llm import quality_model, quality_rules
from tests.compare import same


def test_op1_equals_oracle(spark, duck, sf):
    same(quality_rules.op1_quality_rules(spark, sf), duck.sql(quality_rules.ORACLE_SQL))


def test_verdict_is_the_same_in_any_order():
    rules = quality_rules.RULES[:4]
    for text in ("# " * 40 + "a b", "\n".join(["same line here again"] * 9 + [f"line {i} differs from others" for i in range(30)]), " ".join(f"w{i}" for i in range(50))):
        found = {quality_rules.verdict(quality_rules.Text(text), list(order)) for order in permutations(rules)}
        assert len(found) == 1


def test_cascade_orders_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(" ".join(f"word{i}!" for i in range(100)),)] * 50, "text string")
    slow = quality_rules.Rule("slow, rejects nothing", lambda t: sum(range(20_000)) < 0)
    assert quality_rules.cascade_order(docs, (slow, *quality_rules.RULES[1:2])) == [1, 0]
    assert quality_rules.cascade_order(docs.limit(0), quality_rules.RULES) == list(range(len(quality_rules.RULES)))


def test_order_counts_what_earlier_rules_leave():
    """b rejects more than c, but nothing that a leaves; d and e share a statistic, which the first of them pays."""
    rules = tuple(quality_rules.Rule(x, None, ("s",) if x in "de" else ()) for x in "abcde")
    seconds = {"a": 1.0, "b": 1.1, "c": 1.0, "d": 1.0, "e": 1.0, "s": 30.0}
    sample = [([i < 6, i < 5, 6 <= i < 8, i == 8, i == 9], seconds) for i in range(12)]
    assert quality_rules.order_of(sample, rules) == [0, 2, 3, 4, 1]
    assert quality_rules.order_of([], rules) == [0, 1, 2, 3, 4]


def test_sample_is_bounded_and_moves_no_text(spark):
    docs = spark.range(5000).select(F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(30)]).alias("text")).repartition(40)
    assert 0.7 * quality_rules.SAMPLE_ROWS < len(quality_rules.measured(docs)) < 1.3 * quality_rules.SAMPLE_ROWS


def test_sample_is_of_some_files(spark, tmp_path):
    spark.range(400).select(F.lit("a b").alias("text"), "id").repartition(40).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert files(docs) == 40 and 5 < files(quality_rules.some_files(docs.select("text"))) < 30
    assert quality_rules.some_files(docs.groupBy("text").count()).count() == 1


def test_rules_on_odd_rows(odd, nothing):
    found = {(r.doc_id, (r.text or "")[:5]): r.quality_ for r in quality_rules.judge(odd).collect()}
    assert len(found) == 13 and quality_rules.judge(odd).count() == 14
    assert found[1, ""].n_words == 0 and found[1, ""].base_failed and not found[1, ""].kept
    assert found[3, " \n\t "].n_words == 0 and found[4, "one t"].kept
    assert found[8, "xxxxx"].word_chars == 300_000
    assert quality_rules.judge(nothing).count() == 0 == quality_rules.keep_good(nothing).count()
    assert quality_rules.keep_good(odd).columns == odd.columns and {r.quality for r in quality_rules.keep_good(odd).collect()} == {"q"}


def test_tree_paths():
    told = "  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0)\n    Predict: 0.0\n   Else (feature 1 <= 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    a, b = quality_model.STATISTICS[:2]
    assert {r.tests for r in quality_model.tree_paths(told)} == {
        ((a, True, 1.5),), ((a, False, 1.5),), tuple(sorted([(a, True, 1.5), (b, False, 2.0)])), tuple(sorted([(a, True, 1.5), (b, True, 2.0)])),
    }


PROSE = "The cat sat on the mat. It was warm!\n\nA B 12 #1 | é\nThe cat sat on the mat. It was warm!\n" * 3


def test_statistics_equal_plain():
    import math
    import re

    for text in (None, "", " \n", PROSE, "a a a a b", "ÉCOLE 100% $5\n" * 9):
        flat = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", flat)
        lines = [x for x in flat.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars = max(1, len(words)), max(1, sum(map(len, words)))
        letters, digits = sum(map(str.isalpha, flat)), sum(map(str.isdigit, flat))
        spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        repeated = len({i + j for i, x in enumerate(spans) if spans.count(x) > 1 for j in range(8)})
        expected = (
            math.log1p(len(words)), sum(map(len, words)) / n, sum(c in "#*$%&|<>" for c in flat) / n, flat.count("!") / n, flat.count("|") / n,
            sum(c.isupper() for c in flat) / max(1, letters), letters / chars, digits / chars, (chars - letters - digits) / chars, len(set(words)) / n,
            max([words.count(w) for w in words], default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, repeated / n,
            (len(lines) - len(set(lines))) / max(1, len(lines)), len(words) / max(1, len(lines)), sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(1, len(lines)),
        )
        assert all(abs(a - b) < 1e-12 for a, b in zip(quality_model.statistics(text), expected, strict=True)), text


def test_compiled_score_equals_plain_rules(spark, sf):
    """The column expression of a fitted ensemble against rules that are read one by one."""
    import math

    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality is not null"), "doc_id")
    measured = quality_model.with_statistics(rows.select(F.col("doc_id").alias("id"), "text", F.col("quality").cast("double").alias("label"))).persist()
    model = quality_model.fit(measured)
    assert model.rules and all(len(r.tests) <= 2 * quality_model.DEPTH for r, _ in model.rules)
    for r in measured.withColumn("score", model.score()).collect():
        total = model.intercept + sum(w for rule, w in model.rules if all((r[name] <= bound) == at_most for name, at_most, bound in rule.tests))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_op2_on_odd_tables(spark, odd, nothing, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (10, 0, 0), (2, 0, None), (None, 1, 0), (6, None, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for docs, known, n in ((odd, labels, 14), (odd, labels.limit(0), 14), (nothing, labels, 0)):
        d = str(tmp_path / str(n) / str(known.count()))
        docs.withColumn("log_words", F.lit(1)).write.parquet(f"{d}/documents.parquet")
        known.write.parquet(f"{d}/labels.parquet")
        found = quality_model.op2_quality_model(spark, d).collect()
        assert len(found) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality_model.THRESHOLD) for r in found)


def test_sample_never_falls_to_nothing(spark):
    from tallyreef.llm import common

    df = spark.createDataFrame([(1,)], "id long")
    share = str(df.select(common.in_sample("x", F.col("id"), 20_000, 3 * 10**10))._jdf.queryExecution().optimizedPlan())
    assert str((20_000 << 53) // (3 * 10**10)) in share
    part = spark.range(200_000).filter(common.in_sample("x", F.col("id"), 2_000, 200_000)).count()
    assert 1_700 < part < 2_300 and df.filter(common.in_sample("x", F.col("id"), 5, 1)).count() == 1


def test_op2_held_out(spark, sf):
    """Held-out accuracy of the labelled rows that the model has not seen."""
    d = sf.replace("sf0.001", "sf0.01")
    found = quality_model.op2_quality_model(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("quality is not null")
    held = found.filter("held_out").select("score", "predicted", "quality").collect()
    right = sum(r.predicted == r.quality for r in held) / len(held)
    good, bad = ([r.score for r in held if r.quality == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    print("held-out accuracy", right, "auc", auc, len(held))
    assert right >= 0.85 and auc >= 0.9
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_model_on_odd_rows(spark, odd, nothing):
    measured = quality_model.with_statistics(odd)
    assert measured.count() == 14 and set(quality_model.STATISTICS) <= set(measured.columns)
    one_kind = measured.select(F.col("doc_id").alias("id"), F.lit(1.0).alias("label"), *quality_model.STATISTICS)
    model = quality_model.fit(one_kind.drop("id").withColumn("id", F.lit(1)))
    assert not model.rules and measured.select(model.score().alias("s")).filter("s > 0.99").count() == 14
    none = quality_model.fit(quality_model.with_statistics(nothing).select(F.col("doc_id").alias("id"), F.lit(1.0).alias("label"), *quality_model.STATISTICS))
    assert not none.rules and none.intercept == 0
