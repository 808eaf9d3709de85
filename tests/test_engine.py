"""The engine's own operators: golden values, brute force, and exhaustive small sizes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera import rest, types
from tessera.dialect import to_spark
from tessera.functions import json_fns
from tessera.operators import collections as docs
from tessera.operators import evidence, graph, ledger, recursion, search
from tessera.operators.collection_store import Collection
from tessera.plans import guardrail
from tessera.session import Engine
from tessera.sources import changelog, table_store
from tessera.sources.table_store import TableStore, UniqueViolation, file_system
from tessera.sources.transactions import Conflict, Transaction
from tessera.streaming import seal

SCALARS = [
    ("abs(-5)", 5), ("sqrt(16)", 4.0), ("sign(-3)", -1.0), ("ceil(1.2)", 2.0), ("floor(1.8)", 1.0), ("round(3.14159, 2)", 3.14), ("trunc(-1.9)", -1.0), ("power(2, 3)", 8.0),
    ("log(100)", 2.0), ("mod(7, 3)", 1.0), ("mod(7, 0)", None), ("div(-7, 2)", -3.0), ("gcd(12, 18)", 6), ("lcm(4, 6)", 12), ("greatest(1, NULL, 3)", 3), ("hex(255)", "ff"),
    ("concat('a', NULL, 'b')", "ab"), ("'a' || NULL", None), ("find_idx('hello', 'l')", 3), ("format('%s-%I%%', 'a', 1)", "a-1%"), ("format('%s')", ""), ("to_char(1234.5, '9,999.00')", "1,234.50"),
    ("to_char(-2.675, '9.99')", "-2.67"), ("to_number('$1,234.5', '9')", 1234.5), ("to_number('x', '9')", None), ("CAST(add_month(DATE '2024-01-31', 1) AS TEXT)", "2024-02-29"), ("CAST(last_day(DATE '2023-02-10') AS TEXT)", "2023-02-28"),
    ("TRY_CAST('x' AS INTEGER)", None), ("array_prepend(1, array(2))", [1, 2]), ("array_slice(array(1,2,3,4), 2, 3)", [2, 3]), ("'{\"a\":1}' ->> 'a'", "1"), ("'{\"a\":null}' ->> 'a'", "null"), ("'bad' ->> 'a'", None),
    ("'{\"a\":\"x\"}' -> 'a'", '"x"'), ("'[1,2]' ->> 1", "2"), ("'{\"a\":{\"b\":2}}' -> 'a' ->> 'b'", "2"), ("'[1,[2]]' @> '[1]'", True), ("'{\"a\":1}' <@ '{\"a\":2}'", False), ("json_array('{\"t\":[\"a\",{\"b\":1}]}', 't')", ["a", '{"b":1}']),
    ("jsonb_path_query_first('{\"a\":[1,2]}', '$.a[*]')", "1"), ("jsonb_path_query_array('{\"a\":{\"b\":1,\"c\":2}}', 'strict $.a.*')", "[1,2]"), ("jsonb_path_query('[1]', '$.x')", None),
]


def test_scalars(spark):
    e = Engine(spark)
    row = e.sql("SELECT " + ", ".join(f"({text}) AS v{k}" for k, (text, _) in enumerate(SCALARS))).first()
    for k, (text, want) in enumerate(SCALARS):
        got = row[k]
        assert (float(got) == pytest.approx(want) if isinstance(want, float) else got == want), text


def test_dialect_leaves_strings_alone():
    assert to_spark("SELECT '$1 -> ? ORDER BY x' AS a") == "SELECT '$1 -> ? ORDER BY x' AS a"
    assert to_spark("SELECT a FROM t ORDER BY a", "first").strip().endswith("NULLS FIRST")
    with pytest.raises(ValueError):
        to_spark("SELECT * FROM t WHERE a = j ->> 'k'")
    assert types.normalize("varchar(10)") == ("TEXT", "string") and types.normalize("HUGEINT")[0] == "INTEGER"
    with pytest.raises(ValueError):
        types.normalize("bit")
    assert [types.parameter(x) for x in ("1", "1.5", "true", "null", "x1")] == [1, 1.5, True, None, "x1"]


def test_json_contains():
    for a, b, want in ((1, 1, True), (True, 1, False), ([1, 2], 1, True), ({"a": {"b": 1, "c": 2}}, {"a": {"c": 2}}, True), ([1], [2], False), ({"a": 1}, [1], False)):
        assert json_fns.contains(a, b) == want
    with pytest.raises(ValueError):
        json_fns.parse_path("$..a")


@pytest.mark.parametrize("seed", range(2))
def test_merge_equals_replay(spark, seed):
    rng = random.Random(seed)
    base = {(k, "a"): k * 10 for k in range(15)}
    state, log = dict(base), []
    for seq in range(1, 80):
        key = (rng.randrange(20), rng.choice("ab"))
        if rng.random() < 0.3:
            state.pop(key, None)
            log.append((*key, None, "delete", seq))
        else:
            state[key] = seq
            log.append((*key, seq, "upsert", seq))
    snap = spark.createDataFrame([(*k, v) for k, v in base.items()], "a int, b string, v int")
    entries = spark.createDataFrame(log, "a int, b string, v int, op string, seq long").repartition(3)
    got = {(r.a, r.b): r.v for r in changelog.merge(snap, entries, ["a", "b"]).collect()}
    assert got == state


def test_table_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    t = store.create("t", {"id": "INTEGER", "v": "INTEGER", "label": "TEXT"}, ["id"])
    t.insert(spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c")], "id long, v long, label string"))
    assert t.seal() == t.seal() > 0
    t.update({"v": "v + 1"}, "id = 1")
    t.delete("id = 2")
    with pytest.raises(UniqueViolation):
        t.insert(spark.createDataFrame([(1, 1, "x")], "id long, v long, label string"))
    with pytest.raises(ValueError):
        t.update({"id": 5})
    t.alter(add=("extra", "FLOAT", 1.5))
    t.alter(rename=("label", "name"))
    rows = {r.id: (r.v, r.name) for r in t.read().collect()}
    assert rows == {1: (11, "a"), 3: (30, "c")}
    t.insert(spark.createDataFrame([(9, 90, "n", 2.5)], "id long, v long, name string, extra double"))
    t.seal()
    assert t.compact() == 1
    assert {r.id for r in t.read().collect()} == {1, 3, 9}
    assert [r.column_name for r in store.columns().orderBy("column_id").collect()] == ["id", "v", "name", "extra"]
    with pytest.raises(ValueError):
        t.read(min_seq=10**15)
    with pytest.raises(ValueError):
        store.create("u", {"a": "TEXT"}, [])


def test_streaming_seal(spark, tmp_path):
    schema = "k long, v string, op string, seq long"
    log, out = str(tmp_path / "log"), seal.Sealed(spark, str(tmp_path / "out"), "k long, v string", ["k"])
    spark.createDataFrame([(1, "a", "upsert", 1), (2, "b", "upsert", 2)], schema).write.parquet(log)
    seal.start(spark, log, schema, out, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(1, None, "delete", 3), (3, "c", "upsert", 4)], schema).write.mode("append").parquet(log)
    seal.start(spark, log, schema, out, str(tmp_path / "cp")).awaitTermination()
    assert out.sealed_seq == 4 and {r.k: r.v for r in out.read().collect()} == {2: "b", 3: "c"}
    out.apply(spark.read.schema(schema).parquet(log))  # a replay changes nothing
    assert {r.k: r.v for r in out.read().collect()} == {2: "b", 3: "c"}


def test_collections(spark):
    c = spark.createDataFrame([("1", '{"a":{"b":1},"n":5,"t":["x","y"]}'), ("2", '{"n":"10","t":"z"}'), ("3", "{}")], "_id string, doc string")
    ids = lambda q: {r._id for r in docs.find(c, q).collect()}
    assert ids({"a.b": 1}) == {"1"} and ids({"n": {"$ne": 5}}) == {"2", "3"} and ids({"$not": {"n": {"$gt": 1}}}) == set()
    assert {r._id for r in docs.pipeline(c, [{"$match": {"n": {"$ne": 5}}}]).collect()} == {"2"}
    assert [r.t for r in docs.pipeline(c, [{"$unwind": "$t"}, {"$sort": {"t": 1}}]).collect()] == ["x", "y", "z"]
    for bad in ([{"$facet": {}}], [{"$match": {"a": {"$regex": "x"}}}]):
        with pytest.raises(docs.Unsupported):
            docs.pipeline(c, bad)
    assert docs.updated({"_id": 1, "a": [1, 2]}, {"$push": {"a": 3}, "$pull": {"a": 1}, "$inc": {"z": 2}}) == {"_id": 1, "a": [2, 3], "z": 2}
    assert docs.updated({"_id": 1, "a": 2}, {"b": 3}) == {"_id": 1, "b": 3}
    assert [r.doc for r in docs.find(c, {"_id": "1"}, {"n": 1}).collect()] == ['{"n":5}']
    t = spark.createDataFrame([("1", '{"at":100}'), ("2", '{"at":"1970-01-01T00:10:00Z"}'), ("3", '{"at":"x"}')], "_id string, doc string")
    assert {r._id for r in docs.expired(t, "at", 50, 200).collect()} == {"1"}


def test_rest(spark):
    df = spark.createDataFrame([(1, "a", '{"k":"v"}'), (2, None, None)], "id long, s string, j string")
    assert [r.id for r in rest.Query.parse("s=is.null").run(df).collect()] == [2]
    assert [r.k for r in rest.Query.parse("select=j->>k&id=eq.1").run(df).collect()] == ["v"]
    for bad in ("id", "id=5", "limit=x", "s=is.maybe", "id;x=eq.1"):
        with pytest.raises(ValueError):
            rest.Query.parse(bad).run(df)
    with pytest.raises(ValueError):
        rest.check_mutation(rest.Query.parse(""))


def test_search(spark):
    df = spark.createDataFrame([(1, "Payments are pending", 1), (2, "an overdue notice", 2), (3, "invoice overdue, invoice overdue", None)], "_id long, body string, year long")
    posts = search.postings(df, "_id", "body", "english")
    assert [r.pk for r in search.ranked(posts, search.plain("invoice overdue", "english")).collect()] == [3]
    assert {r.pk for r in search.matches(posts, search.websearch("payment or -invoice overdue", "english")).collect()} == {1, 2}
    assert {r.pk for r in search.matches(posts, search.tsquery("overdue & !invoice", "english")).collect()} == {2}
    index = search.Index(df, {"body": {"type": "text", "analyzer": "english"}, "year": {"type": "integer"}})
    got = index.envelope({"query": {"match_phrase": {"body": "invoice overdue"}}, "highlight": {"fields": {"body": {}}}})
    assert got["total"]["value"] == 1 and "<em>overdue</em>" in got["hits"][0]["_source"]["highlight_body"]
    assert [r._id for r in index.hits({"sort": [{"year": "desc"}]}).collect()] == [2, 1, 3]
    for bad in ({"bool": {}}, {"fuzzy": {"body": "x"}}, {"range": {"body": {"gt": 1}}}):
        with pytest.raises(ValueError):
            index.ids(bad)


def test_full_join_hands_on_pairs_one_by_one(spark):
    rng = random.Random(3)
    a, b = ([(k, rng.choice([1, 1, 1, 2, None, n]), rng.choice([None, *map(float, range(9))])) for k in range(60)] for n in (3, 4))
    engine = Engine(spark, prefix="full_")
    engine.register("a", spark.createDataFrame(a, "k long, g int, v double").repartition(3))
    engine.register("b", spark.createDataFrame(b, "k long, g int, v double").repartition(3))
    pairs = [(x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and None not in (x[2], y[2]) and x[2] > y[2]]
    want = pairs + [(x[0], None) for x in a if x[0] not in {p[0] for p in pairs}] + [(None, y[0]) for y in b if y[0] not in {p[1] for p in pairs}]
    got = engine.sql("SELECT a.k AS x, b.k AS y FROM full_a a FULL JOIN full_b b ON a.g = b.g AND a.v > b.v")
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    assert order(got.collect()) == order(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in plan and not any("*(" in x for x in plan.splitlines() if "FullOuter" in x)  # compiled, it would hold all pairs of a key


def test_graph(spark):
    e = spark.createDataFrame([("A", "B", "x", 2), ("A", "B", "y", 9), ("A", "C", "x", 5), ("C", "D", "x", 4), ("B", "D", "x", 3)], "src string, dst string, type string, weight long")
    assert [(r.node, r.weight) for r in graph.neighbours(e, "A", floor=5).collect()] == [("B", 9), ("C", 5)]
    assert {r.node for r in graph.reachable(e, spark.createDataFrame([("A",), ("Z",)], "n string"), floor=4).collect()} == {"A", "B", "C", "D", "Z"}
    assert graph.widest_path(e, "A", "D") == (True, 4) and graph.widest_path(e, "D", "A") == (False, None) and graph.widest_path(e, "A", "A") == (True, None)
    after = graph.mutate(e, upserts=spark.createDataFrame([("A", "B", "x", 1), ("N", "M", "x", 1)], e.schema.fieldNames() and "src string, dst string, type string, weight long"), deletes=spark.createDataFrame([("N", "M", "x")], "src string, dst string, type string"), merge="max")
    assert graph.changed(e, after) == 0


def test_widest_over_all_edges(spark, tmp_path):
    from tessera.plans import shapes

    rng = random.Random(6)
    rows = [(rng.randint(1, 12), rng.randint(1, 25), float(rng.randint(1, 50))) for _ in range(60)] + [(90, 90, 5.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    weight: dict = {}
    for s, p, q in rows:
        weight[f"s{s}", f"p{p}"] = weight.get((f"s{s}", f"p{p}"), 0) + int(q)
    arcs = [(*e, w) for (a, b), w in weight.items() for e in ((a, b), (b, a))]
    best = {"s1": 10**9}
    for _ in range(len(arcs)):  # until nothing changes, at most as many rounds as arcs
        for a, b, w in arcs:
            if a in best:
                best[b] = max(best.get(b, 0), min(best[a], w))
    want = {k: None if k == "s1" else w for k, w in best.items()}
    assert any(k[0] == "s" and int(k[1:]) > 3 for k in want)
    assert {r.node: r.bottleneck for r in shapes.g_widest_all(spark, str(tmp_path)).collect()} == want


def test_traversals_leave_their_arcs_in_place(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"n{i}", f"n{i + 1}", "x", rng.randint(5, 90)) for i in range(12)] + [(f"n{rng.randint(0, 12)}", f"m{i % 300}", "x", rng.randint(1, 90)) for i in range(900)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string, weight long")
    scans = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(w):
        scans.add(1)
        return w

    counted = counted.asNondeterministic()
    best = {"n0": 10**9}
    for _ in range(13):
        for a, b, _, w in rows:
            if a in best:
                best[b] = max(best.get(b, 0), min(best[a], w))
    seen = edges.withColumn("weight", counted("weight"))
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert {r.node: r.bottleneck for r in graph.widest(seen, "n0").collect()} == {k: None if k == "n0" else w for k, w in best.items()}
            assert {r.node for r in graph.reachable(seen, spark.createDataFrame([("n0",)], "node string"), 1).collect()} == set(best)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert scans.value <= 2 * 2 * 2 * len(rows)  # each traversal makes the edges once, whatever its rounds (a filter may be worked out twice)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    arcs, parts = graph._arcs(edges.select("src", "dst"), False)
    met = arcs.join(spark.createDataFrame([("n0",)], "node string").hint("merge").repartition(parts, "node"), F.col("src") == F.col("node"))
    assert met.count() == sum("n0" in r[:2] for r in rows)
    arcs.unpersist()


def test_row_number_of_all_orders(spark, tmp_path):
    from tessera.plans import shapes

    rng = random.Random(4)
    rows = [(k, None if k % 97 == 0 else float(rng.randint(1, 300))) for k in range(0, 20000, 3)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    want = {k: n + 1 for n, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])))}
    assert {r.o_orderkey: r.rn for r in shapes.w_row_number_all(spark, str(tmp_path)).collect()} == want


def test_merkle_all_sizes(spark):
    every = []
    for n in range(1, 33):
        leaves = [hashlib.sha256(bytes([n, k])).digest() for k in range(n)]
        every += [(str(n), k, h.hex()) for k, h in enumerate(leaves)]
        top = evidence.root(leaves)
        for k in range(n):
            proof = evidence.inclusion_proof(leaves, k)
            assert evidence.verify_inclusion(leaves[k], k, n, proof, top)
            assert not evidence.verify_inclusion(b"x" * 32, k, n, proof, top)
        for old in range(1, n + 1):
            assert evidence.verify_consistency(old, n, evidence.root(leaves[:old]), top, evidence.consistency_proof(leaves, old)), (old, n)
    got = {r.chain: r.root for r in evidence.roots(spark.createDataFrame(every, "chain string, seq long, leaf_hash string")).collect()}
    for n in range(1, 33):
        assert got[str(n)] == evidence.root([hashlib.sha256(bytes([n, k])).digest() for k in range(n)]).hex()


def test_ledger():
    book = ledger.Ledger()
    A, T = ledger.Account, ledger.Transfer
    assert book.create_accounts([A(1, 1, 1), A(2, 1, 1, ledger.DEBITS_LIMITED), A(1, 1, 1), A(0, 1, 1)]) == ["ok", "ok", "exists", "id_must_not_be_zero"]
    assert book.create_transfers([T(1, 2, 1, 5, 1, 1)]) == ["exceeds_credits"]
    assert book.create_transfers([T(2, 1, 2, 100, 1, 1), T(3, 2, 1, 60, 1, 1, ledger.PENDING, timeout=1)]) == ["ok", "ok"]
    assert book.create_transfers([T(4, flags=ledger.POST, pending_id=3, amount=40)]) == ["ok"]
    assert book.create_transfers([T(5, flags=ledger.VOID, pending_id=3)]) == ["pending_transfer_already_posted"]
    assert book.create_transfers([T(6, 1, 2, 1, 1, 1, ledger.LINKED), T(7, 1, 9, 1, 1, 1)]) == ["linked_event_failed", "credit_account_not_found"]
    assert book.create_transfers([T(8, 1, 2, 1, 1, 1, ledger.LINKED)]) == ["linked_event_chain_open"]
    assert book.create_transfers([T(9, 2, 1, 10, 1, 1, ledger.PENDING, timeout=1, timestamp=0)]) == ["ok"]
    assert book.create_transfers([T(10, flags=ledger.POST, pending_id=9, amount=ledger.U128)], now=2 * 10**9) == ["pending_transfer_expired"]
    assert sum(a.debits_posted for a in book.accounts.values()) == sum(a.credits_posted for a in book.accounts.values()) == 140
    assert all(a.debits_pending == a.credits_pending == 0 for a in book.accounts.values())



TRANSFERS = "ledger long, seq long, id string, debit string, credit string, amount string, code long, flags long, pending_id string"


def test_ledgers_are_cut_where_transfers_share_nothing(spark, monkeypatch):
    monkeypatch.setattr(ledger, "PASS", 7)
    rng = random.Random(5)
    rows = []
    for book in range(1, 6):
        ids = [str(rng.choice([k, k, k, max(1, k - 1), max(1, k - 9)])) for k in range(1, 121)]
        for seq, i in enumerate(ids):
            a, b = rng.sample(range(1, 9 if book == 1 else 60), 2)
            kind = rng.choice([0, 0, ledger.PENDING, ledger.PENDING, ledger.POST, ledger.POST, ledger.VOID])
            kind |= rng.choice([0] * 12 + [ledger.BALANCING_DEBIT, ledger.BALANCING_CREDIT, ledger.LINKED] if book < 4 else [0])
            resolves = kind & (ledger.POST | ledger.VOID)
            amount = rng.choice([1, 5, 30, ledger.U128 if resolves or book == 3 and not seq % 9 else 7])
            if resolves:
                a, b, amount = 0, 0, rng.choice([0, 1, amount])
            odd = "0" if rng.random() < 0.2 else ""
            rows.append((book, seq, odd + i, odd + str(a), str(b), str(amount), rng.choice([1] * 9 + [0]), kind, odd + str(rng.randint(max(1, seq - 9), seq + 1)) if resolves else "0"))
    rows += [(3, 200 + k, str(500 + k), "70", str(71 + k), str(ledger.U128), 1, 0, "0") for k in range(3)]
    rows += [(6, k, f" {k % 5 + 1}", "1", "2", "3", 1, 0, "0") for k in range(20)]
    rows += [(7, k, str(k // 40 + k), "1", "2", "3", 1, 0, "0") for k in range(200)]
    want = {}
    for n in range(1, 8):
        book, of = ledger.Ledger(), sorted((r for r in rows if r[0] == n), key=lambda r: (r[1], r[2]))
        for x in {int(x) for r in of for x in r[3:5]}:
            book.create_accounts([ledger.Account(x, n, 1)])
        codes = book.create_transfers([ledger.Transfer(int(r[2]), int(r[3]), int(r[4]), int(r[5]), n, r[6], r[7], int(r[8])) for r in of])
        want |= {(n, r[1], r[2]): code for r, code in zip(of, codes, strict=True)}
    assert {"ok", "exists", "linked_event_failed", "overflows_debits", "pending_transfer_already_posted", "pending_transfer_not_found", "pending_transfer_not_pending"} <= set(want.values())
    rng.shuffle(rows)
    for some in (rows, [r for r in rows if r[0] == 7]):
        t = spark.createDataFrame(some, TRANSFERS).repartition(3)
        got = [((r.ledger, r.seq, r.id), r.result) for r in ledger.run(t).collect()]
        assert len(got) == len(some) and dict(got) == {k: v for k, v in want.items() if k[0] in {r[0] for r in some}}
        sizes = {(r._pass, r._of): r["count"] for r in ledger._passes(t).groupBy("_pass", "_of").count().collect()}
        assert len(sizes) > 20 and max(n for (p, _), n in sizes.items() if p >= 0) < 40
        assert {of for p, of in sizes if p < 0} <= set(range(1, 7)) and (-1, 7) not in sizes
    cut = ledger._passes(spark.createDataFrame(rows, TRANSFERS)).where("_pass >= 0").groupBy("ledger").count()
    assert {r.ledger for r in cut.collect()} >= {2, 3, 4, 5, 7}


def test_one_large_ledger_is_no_single_group(spark):
    rows = [(1, k, str(k + 1), str(k % 90 + 2), "1", "5", 1, 0, "0") for k in range(45000)]
    sizes = spark.createDataFrame(rows, TRANSFERS)
    groups = [r.n for r in ledger.run(sizes).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(groups) == 45000
    plan = ledger.run(sizes)._jdf.queryExecution().optimizedPlan().toString()
    assert "_pass" in plan and ledger._passes(sizes).select("_pass").distinct().count() == 3


def test_transactions_and_collections_with_writes(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    t = store.create("t", {"id": "INTEGER", "v": "INTEGER"}, ["id"])
    with Transaction(store) as tx:
        tx.insert("t", spark.createDataFrame([(1, 1), (2, 2)], "id long, v long"))
        tx.update("t", {"v": "v * 10"}, "id = 1")
        tx.delete("t", "id = 2")
        assert {r.id: r.v for r in tx.read("t").collect()} == {1: 10}
        assert t.read().count() == 0
    assert {r.id: r.v for r in t.read().collect()} == {1: 10}
    tx = Transaction(store)
    tx.read("t")
    assert [r.v for r in t.update_returning({"v": "v + 1"}).collect()] == [11]
    with pytest.raises(Conflict):
        tx.commit()
    assert [r.id for r in t.delete_returning().collect()] == [1] and t.read().count() == 0
    c = Collection(store, "people")
    c.insert([{"_id": "a", "n": 1}, {"_id": "b", "n": 2, "at": 10}])
    c.create_index("u", ["n"], unique=True)
    with pytest.raises(UniqueViolation):
        c.insert([{"n": 2}])
    assert c.update({"n": 1}, {"$set": {"n": 5}}) == 1 and c.count({"n": 5}) == 1
    c.create_index("ttl", ["at"], expire_after=5)
    assert c.sweep(now=100) == 1 and c.delete({"n": 5}) == 1 and c.count() == 0


def test_transactions_read_what_they_touched_first(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    t = store.create("t", {"id": "INTEGER"}, ["id"])
    row = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    t.insert(row(1))
    tx = Transaction(store)
    assert tx.read("t").count() == 1
    t.insert(row(2))
    t.seal()
    assert tx.read("t").count() == 1 and t.read().count() == 2  # also after a seal
    tx.insert("t", row(3))
    with pytest.raises(Conflict):
        tx.commit()
    assert {r.id for r in t.read().collect()} == {1, 2}


@pytest.mark.parametrize("step", ["staged", "first", "both"])
def test_a_writer_that_dies_leaves_nothing(spark, tmp_path, monkeypatch, step):
    store = TableStore(spark, str(tmp_path))
    a, b = (store.create(n, {"id": "INTEGER"}, ["id"]) for n in "ab")
    row = lambda i: spark.createDataFrame([(i,)], "id long")
    tx = Transaction(store)
    tx.insert("a", row(1)), tx.insert("b", row(1))
    left = {"staged": 0, "first": 1, "both": 2}[step]
    real = type(a)._publish

    def dies(self, manifest):
        nonlocal left
        if not left:
            raise SystemError("killed")
        left -= 1
        real(self, manifest)

    monkeypatch.setattr(type(a), "_publish", dies)
    monkeypatch.setattr(store, "settle", lambda *_: (_ for _ in ()).throw(SystemError("killed")))
    with pytest.raises(SystemError):
        tx.commit()
    monkeypatch.undo()
    assert a.read().count() == 0 == b.read().count()
    a.insert(row(1))  # the next writer ends what was begun
    assert [x.read().count() for x in (a, b)] == [1, 0] and a.seal() and a.read().count() == 1
    file_system(spark, a.path)[0].create(file_system(spark, f"{a.path}/manifest-{a.manifest['number'] + 1:012d}.json")[1]).close()
    assert a.read().count() == 1  # a manifest that was begun and not ended holds nothing
    with pytest.raises(Conflict):
        a.insert(row(2))
    monkeypatch.setattr(table_store, "LEASE_MS", -1)
    assert a.insert(row(2)) == 1 and a.read().count() == 2


def test_bm25_from_scans_equals_postings(spark):
    texts = ["a b a", "b c", "", None, "c c c c d", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    posts = search.postings(df, "id", "t")
    for wanted in (["a", "c"], ["b"], ["none"], ["c", "x", "x"]):
        want = {r.pk: round(r.score, 9) for r in search.bm25(posts, wanted).collect()}
        assert {r.pk: round(r.score, 9) for r in search.bm25_scan(df, "id", "t", wanted).collect()} == want
    assert {r.pk for r in search.matches(posts, ("not", ("term", "a")), df.selectExpr("id as pk")).collect()} == {1, 2, 3, 4, 5}


def test_recursion_json_and_guardrail(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    got = recursion.recursive_union(spark.createDataFrame([(1,)], "n int"), lambda new: new.join(edges, F.col("n") == F.col("a")).select("b"))
    assert {r.n for r in got.collect()} == {1, 2, 3}
    row = recursion.json_rows(spark.sql("select 1.50 as d, '{\"a\":1}' as j, cast(null as string) as n"), ("j",)).first()[0]
    assert row == '{"d":"1.50","j":{"a":1},"n":null}'
    spark.range(200).write.parquet(str(tmp_path / "t.parquet"))
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    assert guardrail.check(df, {"t": [["id"]]}).count() == 100
    assert guardrail.check(df.where("id = 5"), {"t": [["id"]]}).count() == 1
    with pytest.raises(guardrail.NoIndex):
        guardrail.check(df.groupBy().count(), {"t": [["id"]]})


def test_queries_have_sql():
    import __spark_entry__ as e

    missing = set(e.oracle_sql()) - set(e.queries())
    assert not missing and len(e.queries()) > 80
    assert F is not None
