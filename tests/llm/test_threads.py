from stackwise.llm import threads
from stackwise.llm.threads import link_quotes, parse, passages, split_levels

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
TALK = [
    (1, 0, "user", "Where is the key?\nI have looked everywhere.", None),
    (1, 1, "assistant", "On Monday, user wrote:\n> Where is the key?\n> I have looked everywhere.\n\nUnder the mat.", None),
    (1, 2, "user", "> > Where is the\n> > key?\n> Under the MAT.\n\nThanks a lot!", None),
    (1, 3, "user", "No quotes here.", None),
    (1, 4, None, ">I have looked everywhere.\nReally everywhere?", None),
    (1, 5, "user", "> never written before\nodd", None),
    (2, 9, "user", "> Where is the key?\nOther conversation, no original.", None),
    (2, 10, "user", None, None),
    (2, 11, "user", "", None),
    (None, 1, "user", "> Under the mat.\nnull conversation", None),
]


def test_parse():
    assert split_levels("> > a\n >b\nc > d") == [(2, "a"), (1, "b"), (0, "c > d")]
    assert passages([(0, "a"), (0, "b"), (1, "c"), (0, ""), (0, "d")]) == [(0, "a\nb"), (1, "c"), (0, "d")]
    body, own, quotes = parse(TALK[1][3])
    assert body == "Under the mat." and len(own) == 1 and [level for level, _ in quotes] == [1, 1, 1]
    assert parse("On time he wrote: well")[0] == "On time he wrote: well"


def test_links(spark):
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(TALK, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(TALK)
    tree = {k: (r.parent_turn, r.root_turn, r.depth) for k, r in got.items()}
    assert tree == {
        (1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 3): (None, 3, 0), (1, 4): (0, 0, 1), (1, 5): (None, 5, 0),
        (2, 9): (None, 9, 0), (2, 10): (None, 10, 0), (2, 11): (None, 11, 0), (None, 1): (None, 1, 0),
    }
    assert got[1, 2].message == "<|user|>\nThanks a lot!" and got[2, 10].body == "" and got[1, 4].message.startswith("<||>")
    assert all(">" not in r.body for r in got.values())


def test_against_sql(spark, tmp_path):
    import duckdb

    from stackwise.llm.queries import ORACLE_SQL, QUERIES

    more = [(5, 0, "user", "a b\nc d\n\ne f", None), (5, 1, "x", "--- Original Message ---\n>a B\n> c\td\n>\n> E f\n\n\n\nreply", None), (5, 2, "y", ">> c d\n> reply\n\r\nOn time wrote:\ntext  ", None), (5, 3, "y", "> reply\n>> e F!", None), (5, 3, "y", "twice", None)]
    spark.createDataFrame(TALK + more, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * EXCLUDE (depth) FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op6_chat_formatting"])
    names = [c[0] for c in want.description]
    got = QUERIES["op6_chat_formatting"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_long_chains_and_repeated_rows(spark):
    chain = [(7, k, "user", (f"> note number {k - 1}\n" if k else "") + f"note number {k}", None) for k in range(70)]
    got = link_quotes(spark.createDataFrame(chain + chain[3:5], SCHEMA)).collect()
    assert sorted((r.turn, r.root_turn, r.depth) for r in got) == sorted((k, 0, k) for _, k, *_ in chain + chain[3:5])


def test_empty(spark):
    assert link_quotes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert threads.digest("... --") is None
