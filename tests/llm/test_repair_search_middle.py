import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from tallyreef.llm import conversation_repair, cross_polytope, fill_middle
from tallyreef.llm.repair_costs import Repairer
from tests.compare import same

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
LONG = {"s": "system", "u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, edits) of rows (initial, must go, truncated) by trying every edit in every place."""

    @cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 4:
            found += [(3 + c, "I" + e) for x in "ua" if (state, x) in NEXT for c, e in [best(i, NEXT[state, x], inserted + 1)]]
        if i < len(rows):
            initial, gone, cut = rows[i]
            c, e = best(i + 1, state, 0)
            found.append((4 + c, "D" + e))
            if not gone:
                if (state, initial) in NEXT:
                    c, e = best(i + 1, NEXT[state, initial], 0)
                    found.append((3 * cut + c, "K" + e))
                found += [(3 + 3 * cut + c, "R" + e) for x in "ua" if (state, x) in NEXT for c, e in [best(i + 1, NEXT[state, x], 0)]]
        return min(found, default=(10**6, ""))

    return best(0, "", 0)


def plain_repair(rows):
    """op11's rows of (conv_id, turn, role, text)."""
    groups, shown = {}, lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        damage = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20
        kept = groups.setdefault(conv_id, [])
        role, text = shown(role), shown(text)
        if damage == 1:
            text = ""
        if damage == 2:
            text = re.sub("[.!?]", "", text)
        if damage == 4:
            role = "user"
        kept += [(turn, role, text)] * (damage != 0) * (2 if damage == 3 else 1)
    out = []
    for conv_id, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marks, faults = set(), [], [0, 0, 0]
        for _, role, text in kept:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marks.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(tuple(marks))
        lines, state, i = [], "", 0
        for edit in audit:
            if edit != "D":
                state = NEXT[state, next(x for x in "sua" if (state, x) in NEXT and x in (kept[i][1][:1] if edit == "K" else "ua"))]
                lines.append((kept[i][1] if edit == "K" else LONG[state]) + ":" + ("" if edit == "I" else kept[i][2]))
            i += edit != "I"
        out.append((conv_id, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def op11_rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_op11_equals_plain_version(spark, sf):
    from_table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op11_rows(conversation_repair.op11_conversation_repair(spark, sf))
    assert found == plain_repair(from_table)
    assert sum(r[6] for r in found) > 0


def test_op11_on_odd_rows(spark, tmp_path):
    random.seed(4)
    texts = ["Fine.", "Cut", " \n", "", None, "Why?", "Same.", "Same.", "é \U0001f600!", "long " * 60_000 + "."]
    rows = [(c, random.choice([None, *range(9)]), random.choice(["user", "assistant", "system", "tool", "", None, "User"]), random.choice(texts)) for c in [None, *range(40)] for _ in range(random.randint(1, 14))]
    rows += rows[:30] + [(99, t, "user", "Hi.") for t in range(400) if zlib.crc32(f"99:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame([(*r, 7, True, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, alive boolean, audit string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = op11_rows(conversation_repair.op11_conversation_repair(spark, str(tmp_path)))
    assert found == plain_repair(rows)
    assert (99, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found
    assert conversation_repair.audits(conversation_repair.damaged(df.filter("conv_id < 0"))).count() == 0


def test_repaired_rows_follow_the_grammar(spark, sf):
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    found = conversation_repair.audits(rows)
    roles = {}
    for r in sorted(conversation_repair.repaired(rows, found).collect(), key=lambda r: (r.conv_id, r.place)):
        roles.setdefault(r.conv_id, []).append(r.role[:1])
        assert r.place == len(roles[r.conv_id]) - 1
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in roles.values())


def test_repair_costs_equal_trying_everything():
    random.seed(9)
    repairer = Repairer(conversation_repair.TURNS, conversation_repair.SYMBOLS)
    for k in range(3000):
        some = range(len(repairer.symbols) if k % 2 else 6)
        codes = [random.choice(some) for _ in range(random.randint(0, 13))]
        rows = tuple((x, extra is None, bool(extra)) for x, extra in (repairer.symbols[c] for c in codes))
        assert repairer.repair(codes)[:2] == cheapest(rows)
    # The tables stay small whatever comes.
    repairer.repair([random.choice(range(9)) for _ in range(100_000)])
    assert len(repairer.vectors) < 100 and len(repairer.forward) < 1000 and len(repairer.backward) < 5000


def test_op12_equals_oracle(spark, duck, sf):
    same(fill_middle.op12_fill_in_middle(spark, sf), duck.sql(fill_middle.ORACLE_SQL))


def test_op12_has_no_python_and_no_shuffle(spark, sf):
    plan = fill_middle.op12_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def plain_middle(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    if h[3] % 100 < spm_rate:
        return len(units), "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return len(units), "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 0), (70, 100)])
def test_op12_on_odd_rows(spark, odd, rate, spm_rate):
    more = [(20, "a<S>b\nc"), (21, "\n\n\n"), (22, "<P\n>x\n<M\n<S\n>"), (23, "é\U0001f600\r\nüß\n" * 300), (24, "no end"), (25, "<\nP>\nM>\nS>")]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).withColumnsRenamed({"key": "fim", "size": "fim_step", "ids": "FIM_"})
    done = fill_middle.fill_in_middle(docs, rate=rate, spm_rate=spm_rate)
    assert done.columns == [*docs.columns, "fim__"]
    found = done.select("doc_id", "text", "fim", "fim__", fill_middle.restored(done["fim__.text"], done["fim__.form"]).alias("back")).collect()
    assert len(found) == docs.count()
    for r in found:
        assert tuple(r.fim__) == plain_middle(r.doc_id, r.text, rate, spm_rate)
        assert r.back == (r.text or "") and r.fim in ("k", None)
    assert fill_middle.fill_in_middle(docs.filter("doc_id < 0")).count() == 0


def brute(vectors, top, every):
    """query_id, ids of its nearest rows, by all pairs."""
    out = []
    for i, (qid, q) in enumerate(vectors):
        if qid % every == 0:
            scores = sorted((-float(np.dot(q, v)), vid, j) for j, (vid, v) in enumerate(vectors) if j != i and len(v) == len(q))
            out.append((qid, [(vid, -s) for s, vid, _ in scores[:top]]))
    return out


def test_op13_recall_and_scores(spark, sf):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    values = dict(rows)
    wanted = brute(rows, 20, 20)
    found = {}
    for r in cross_polytope.op13_cross_polytope(spark, sf).orderBy("query_id", "rank").collect():
        assert abs(r.score - float(values[r.query_id] @ values[r.vec_id])) < 1e-12 and r.query_id != r.vec_id
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id, r["rank"]))
    assert set(found) == {q for q, _ in wanted}
    assert all(x == sorted(x) and [y[2] for y in x] == list(range(1, len(x) + 1)) for x in found.values())
    recall = np.mean([len({v for v, _ in near} & {y[1] for y in found[q]}) / len(near) for q, near in wanted])
    print("recall", recall)
    assert recall >= 0.9


def test_hadamard_and_cells():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(50, 24))
    y = cross_polytope.rotated(x, 3)
    assert y.shape == (50, 32) and np.allclose(y @ y.T, x @ x.T)
    matrix = np.array([[1.0]])
    while len(matrix) < 32:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    z = draw.normal(size=(9, 32))
    assert np.allclose(cross_polytope.hadamard(z), z @ matrix / np.sqrt(32))
    # The cell of a row is its first probe, and all probes are all cells.
    assert (cross_polytope.probes(x, 3, 64)[:, 0] == cross_polytope.cells(x, 3)).all()
    assert (np.sort(cross_polytope.probes(x, 3, 64), axis=1) == np.arange(64)).all()


def test_norms_that_differ_and_groups_of_copies():
    """Recall by inner product holds where norms differ by far, and copies all come."""
    draw = np.random.default_rng(8)
    v = draw.normal(size=(3000, 20)) * draw.uniform(0.1, 10, (3000, 1))
    v[500:560] = v[500]
    ids = np.arange(3000)
    tables = cross_polytope.Tables(ids, ids, v)
    assert tables.level
    places, found, scores = tables.nearest(ids[500:560], v[500:560], 20)
    wanted = brute(list(zip(ids.tolist(), v, strict=True)), 20, 1)[500:560]
    recall = np.mean([len({x for x, _ in near} & set(found[places == i].tolist())) / 20 for i, (_, near) in enumerate(wanted)])
    assert recall >= 0.9 and 0 < tables.met < tables.pairs


def test_op13_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, None, 2), (2, [nan, 1.0], 3), (3, [inf, 1.0], 4), (4, [None, 1.0], 5), (5, [], 6), (None, [1.0, 1.0], 7), (6, [1.0, 1.0], 8), (6, [1.0, 1.0], 9), (7, [1.0, 1.0], 9), (20, [-1.0, 0.25, 3.0], 1), (40, [0.5, 0.5], 1), (8, [0.0, 0.0], 2), (9, [1e300, -1e300], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    found = [tuple(r) for r in cross_polytope.nearest(df, top=3, n_probes=99).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 9, 5e299), (0, 2, 6, 1.5), (0, 3, 6, 1.5), (40, 1, 6, 1.0), (40, 2, 6, 1.0), (40, 3, 7, 1.0)]
    assert cross_polytope.nearest(df.filter("vec_id < 0")).count() == 0
    twice = spark.createDataFrame([(20, [1.0])] * 2 + [(1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted((r["rank"], r.vec_id, r.score) for r in cross_polytope.nearest(twice).collect()) == [(1, 1, 2.0)] * 2 + [(2, 20, 1.0)] * 2
