import duckdb
import pytest

from lodestone.llm.leaks import Leaks, leaks, without_leaks
from lodestone.llm.queries import ORACLES

ITEM = "A train left Bern at 9.30 with 120 passengers and after 45 minutes another train with 120 passengers left Basel. How many passengers did both trains carry?"
CHANGED = "A train left Rome at 7.15 with 80 passengers and after 25 minutes another train with 80 passengers left Milan. How many passengers did both trains carry?"
TWISTED = "A train left Rome at 7.15 with 80 passengers and after 25 minutes another train with 95 passengers left Milan. How many passengers did both trains carry?"
CLEAN = "The harbour was quiet that morning and nobody on the pier had seen the ferry come in before the fog lifted at last over the bay."


def tables(spark):
    docs = [(1, f"{CLEAN} {ITEM} {CLEAN}"), (2, f"{CLEAN}\n{CHANGED}"), (3, f"{CLEAN} {TWISTED}"), (4, CLEAN), (5, None), (6, ""), (7, ITEM.upper()), (8, ITEM.lower()),
            (9, ITEM[:60]), (None, f"x {ITEM}"), (10, "\n".join([ITEM] * 3)), (11, "the " * 5000), (12, " ".join(ITEM.split(" ")[:-7] + ["and", "what"])), (1, CLEAN),
            (13, "what is 7 kg plus 5 kg now"), (14, "Anna Bert Carl Dora Emil Franz Gerd")]
    items = [(1, ITEM), (2, "what is 3 kg plus 4 kg now"), (3, "a b"), (4, None), (1, ITEM), (5, "Hans Ida Jan Karl Lisa Max Nora"), (6, "the the the the the the the the")]
    return (spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, hash string, need int").repartition(3),
            spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n int"))


def test_leaks_of_a_fixture(spark):
    got = {(r.doc_id, r.item_id): r for r in leaks(*tables(spark)).collect()}
    assert set(got) == {(1, 1), (2, 1), (8, 1), (10, 1), (None, 1), (13, 2), (11, 6)}
    assert got[1, 1].changed == 0 and got[1, 1].coverage == 1.0 and got[2, 1].changed == 5 and got[2, 1].slots == 6
    left = without_leaks(*tables(spark))
    # of the two rows with key 1, that without the item stays
    assert sorted((r.doc_id, r.text == CLEAN) for r in left.collect()) == [(1, True), (3, False), (4, True), *((i, False) for i in (5, 6, 7, 9, 12, 14))]
    assert left.columns == ["doc_id", "text", "hash", "need"]


def test_sql_says_the_same(spark):
    docs, items = tables(spark)
    docs, items = docs.where("doc_id is not null and not (doc_id = 1 and length(text) < 200)"), items.distinct()
    db = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        db.register(f"{name}_arrow", df.toArrow())
        db.execute(f"create view {name} as select * from {name}_arrow")
    want = db.execute(ORACLES["op9_template_leaks"]).fetchall()
    assert sorted(tuple(r) for r in leaks(docs, items).drop("doc_hash").collect()) == sorted(want)


@pytest.mark.parametrize("side", [0, 1])
def test_empty_sides(spark, side):
    both = list(tables(spark))
    both[side] = both[side].limit(0)
    assert leaks(*both).count() == 0


def test_large_benchmarks_are_not_broadcast(spark):
    a = sorted(map(str, leaks(*tables(spark), Leaks(broadcast_rows=0)).collect()))
    assert a == sorted(map(str, leaks(*tables(spark)).collect()))
    plan = leaks(*tables(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_items_without_a_key_and_with_one_for_several_texts(spark):
    docs, other = [(1, f"{CLEAN} {ITEM}"), (2, CLEAN), (None, CLEAN), (None, f"{ITEM} x"), (3, "It is said that 17 gardeners planted 340 tulips along the canal before the first frost came last year")], "so 17 gardeners planted 340 tulips along the canal before the first frost came last year"
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM), (None, other), (None, ITEM), (9, "nothing of this kind was ever seen before in the old town hall")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.changed) for r in leaks(frame, items).collect()) == [(0, None, 0), (1, None, 0), (3, None, 0)]
    assert sorted((r.doc_id or 0) for r in without_leaks(frame, items).collect()) == [0, 2]
    shared = items.withColumn("item_id", items.item_id * 0 + 4).fillna(4)
    assert sorted((r.doc_id or 0, r.item_id, r.coverage) for r in leaks(frame, shared).collect()) == [(0, 4, 1.0), (1, 4, 1.0), (3, 4, 11 / 12)]


def test_both_forms_of_a_window_reach_the_slots(spark):
    docs, items = tables(spark)
    runs = [sorted(map(str, leaks(docs.repartition(n), items.repartition(8 - n)).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]
