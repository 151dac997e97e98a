"""What the physical plans of the operators must and must not hold."""

import pytest

from korpuslab.llm import ann, brown, langid, lines, mixing, sharding, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [mixing.mix_documents, mixing.mixed_rows, sharding.shard_documents])
def test_native_operators_run_no_python(docs, make):
    assert not any(word in plan(make(docs)) for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("make", [mixing.mix_documents, sharding.shard_documents, simhash.near_duplicates, lines.dedup_lines, langid.identify, brown.score_documents])
def test_no_operator_pairs_everything(docs, make):
    found = plan(make(docs))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found


def test_neighbours_meet_by_list(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(200)], "vec_id bigint, embedding array<float>")
    found = plan(ann.nearest(df, "vec_id", "embedding", "id % 50 = 0", 3))
    assert "FlatMapCoGroupsInArrow" in found and "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found
