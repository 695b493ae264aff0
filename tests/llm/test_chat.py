import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import chat

PIECES = ["<", "[", "⁠", "s>", "/s>", "INST]", "/INST]", "|im_start|>", "|im_end|>", "\n", "%", "%0A", "%25", "a", "é", *chat.CONTROL]


@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=4), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_round_trip(spark, convs):
    rows = spark.createDataFrame([(i, [(r, t) for r, t in c]) for i, c in enumerate(convs)], "id int, turns array<struct<role:string,text:string>>")
    done = chat.formatted(rows).select("id", "formatted", chat.parsed(F.col("formatted")).alias("back"), F.transform("turns", lambda t: chat.escape(t["text"])).alias("safe"))
    for r in done.collect():
        assert [tuple(t) for t in r.back] == convs[r.id]
        assert not any(c in s for s in r.safe for c in chat.CONTROL)


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = chat.op6_schema_fingerprint_chat(spark, sf).toPandas().sort_values("conv_id").reset_index(drop=True)
    want = con.sql(chat.OP6_SQL).df().sort_values("conv_id").reset_index(drop=True)
    assert got.equals(want[got.columns].astype(got.dtypes.to_dict())) and -7 in set(got.conv_id)


def test_layouts(spark):
    rows = ['{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"id":3}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"i","input":"","output":"o"}', '{"response":"r","prompt":"p"}', "[1,2]", None, '{"x":{"y":1}}', "no json", '{"system":"s","messages":[{"role":"user","content":"hi"}]}']
    got = chat.formatted(chat.canonical_turns(spark.createDataFrame([(r,) for r in rows], "record string"))).collect()
    assert [r.layout for r in got] == ["messages", "sharegpt", "instruction_input", "prompt_response", None, None, None, None, "system_messages"]
    assert [[tuple(t) for t in r.turns] if r.turns is not None else None for r in got] == [[("user", "hi"), ("assistant", "yo")], [("user", "q"), ("assistant", "a")], [("user", "i"), ("assistant", "o")], [("user", "p"), ("assistant", "r")], None, None, None, None, [("system", "s"), ("user", "hi")]]
    for r in got[:4]:
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [r.turns[-1].text]
    assert len({r.schema_fingerprint for r in got[:4]}) == 4 and got[4].formatted is None


def test_edge_cases(spark):
    rows = [(1, 1, None, None, 0), (1, 0, "user", "x" * 200_000, 0), (1, 1, None, None, 0), (None, None, "assistant", "é", 0), (2, 0, "assistant", "", 0)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.format_digests(chat.formatted(chat.canonical_turns(chat.gather_turns(conv)))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[None].loss_chars == 1 and got[2].n_turns == 1
    assert chat.gather_turns(conv.limit(0)).count() == 0


def test_conversations_come_in_all_layouts_and_leave_in_one(spark):
    rows, want = [], {}
    shapes = [["user", "assistant"], ["user", "user", "assistant"], ["system", "user", "assistant"], ["system", "user"], ["user"], ["Human", "gpt"]]
    for i in range(600):
        roles = shapes[i % len(shapes)]
        texts = [["hi", "", '{"a": 1}', "[INST]", '[{"b": 2}]', "a\nb"][(i // 6 + k) % 6 if i % 5 == 0 else 5 * (i % 2)] for k in range(len(roles))]
        rows += [(i, k, r, t) for k, (r, t) in enumerate(zip(roles, texts, strict=True))]
        want[i] = list(zip(roles, texts, strict=True))
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.canonical_turns(chat.gather_turns(conv, layouts=tuple(chat.LAYOUTS))).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.layout for r in got} == set(chat.LAYOUTS)


def test_the_query_meets_several_layouts(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = chat.canonical_turns(chat.gather_turns(rows, layouts=tuple(chat.LAYOUTS))).collect()
    assert len({r.layout for r in got}) >= 5 and None not in {r.layout for r in got}
