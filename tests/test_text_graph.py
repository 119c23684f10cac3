import random

import pytest
from pyspark.sql import functions as F

from recengine.functions import text as T
from recengine.operators import graph as G
from recengine.operators.text import UNK_ID, build_vocabulary, frequent_tokens, inverted_index, tokenize


def test_inverted_index_gap_and_repeated_term(spark):
    df = spark.createDataFrame([(1, {"foo": [0, 3], "bar": [1]}, 5), (2, {}, 3)],
                               "id long, idx map<string,array<int>>, n int")
    out = df.withColumn("p", T.index_pairs("idx")).select("id", T.text_from_pairs("p", "n").alias("t"))
    got = {r.id: r.t for r in out.collect()}
    assert got[1] == "foo bar  foo "          # positions 0..4: foo bar '' foo ''
    assert got[2] == "  "                     # three empty tokens


def test_inverted_index_roundtrip(spark):
    df = spark.createDataFrame([(1, "a b  a c"), (2, "x")], "id long, text string")
    idx = inverted_index(df, "id", "text").withColumn("p", T.index_pairs("index"))
    got = {r.id: r.t for r in idx.select("id", T.text_from_pairs("p", "length").alias("t")).collect()}
    assert got == {1: "a b  a c", 2: "x"}


def test_inverted_index_shuffles_texts_once_and_no_words(spark):
    df = spark.createDataFrame([(1, "a b  a the c"), (2, None), (3, ""), (None, "x y"), (4, "p q p"), (4, "q r"), (5, "the the")], "id long, text string")
    idx = inverted_index(df, "id", "text", drop_terms=("the",))
    plan = idx._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted(((r.id, {k: list(v) for k, v in r["index"].items()}, r.length) for r in idx.collect()), key=str)
    both = {"p": [0, 2], "q": [0, 1], "r": [1]}             # rows of one key share the index
    assert got == sorted([(1, {"a": [0, 3], "b": [1], "": [2], "c": [5]}, 6), (2, {}, None), (3, {"": [0]}, 1), (None, {}, 2),
                          (4, both, 3), (4, both, 2), (5, {}, 2)], key=str)


def test_strip_html_subset(spark):
    html = ('<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x:1}</style>'
            '<script>var s="</p>";</script></head><body><!-- c --><p>A\n<b>b</b>&lt;3\t</p></body></html>')
    out = spark.createDataFrame([(html,)], "h string").select(T.strip_html("h").alias("t")).first().t
    assert out == "T & UAb<3"


def test_documents(spark):
    df = spark.createDataFrame([(["a", "b"], None)], "f array<string>, about string")
    assert df.select(T.course_document("f", "about")).first()[0] == "Topic 1: a\nTopic 2: b\nDescription: "
    m = spark.createDataFrame([("Toy (1995)", "A|B")], "n string, g string")
    assert m.select(T.movie_document(T.clean_title("n"), "g")).first()[0] == "Name: Toy Genres: A, B"
    p = spark.range(1).select(T.paper_document(F.lit("t"), F.lit(2000), F.lit(3), F.lit("J"), F.lit("P"),
                                               abstract=F.lit(None).cast("string")))
    assert p.first()[0] == "t\nYear: 2000\n#Citations: 3\nJ\nP"


def test_tokenize_pad_and_truncate(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "c b a c d e")], "id long, text string")
    vocab = build_vocabulary(df, "text")
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert ids["b"] == 2                      # most frequent first (b:3, then a, c by token)
    tok = {r.id: r for r in tokenize(df, "id", "text", vocab, 4).collect()}
    assert tok[1].input_ids == [ids["b"], ids["a"], ids["b"], 0]
    assert tok[1].attention_mask == [1, 1, 1, 0]
    assert tok[2].n_tokens == 6 and len(tok[2].input_ids) == 4


@pytest.mark.parametrize(("top", "tracked"), [(2_000, 100_000), (2, 64), (1, 16)])
def test_tokenize_against_plain_python(spark, top, tracked):
    rnd = random.Random(3)
    long_word = "x" * 500
    pool = ["the"] * 60 + ["not-known"] * 30 + [f"w{k}" for k in range(40)] + [long_word] * 5
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    texts += ["", None, "  \t ", "The THE the " * 400]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "id long, text string, token_id int")
    vocab = build_vocabulary(df, "text").where("token <> 'not-known'")
    ids = {r.token: r.token_id for r in vocab.collect()}
    got = {r.id: r for r in tokenize(df, "id", "text", vocab, 6, top, tracked).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        toks = (t or "").lower().split()
        want = [ids.get(w, UNK_ID) for w in toks[:6]]
        assert got[i].input_ids == want + [0] * (6 - len(want))
        assert got[i].n_tokens == len(toks)


def test_tokenize_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a"), (2, None)], "id long, text string")
    vocab = build_vocabulary(df, "text")
    got = sorted((r.id is None, r.id or 0, r.n_tokens, r.input_ids) for r in tokenize(df, "id", "text", vocab, 2).collect())
    # a: 3, b: 2, c: 1; equal rows are one, a key's different texts stay apart
    assert got == [(False, 1, 1, [4, 0]), (False, 1, 2, [2, 3]), (False, 2, 0, [0, 0]), (True, 0, 1, [2, 0])]
    empty = df.where("id > 5")
    assert tokenize(empty, "id", "text", vocab, 2).count() == 0


def test_frequent_tokens_leave_the_shuffle(spark):
    df = spark.createDataFrame([(i, "hot " * 20 + f"rare{i}") for i in range(200)], "id long, text string")
    vocab = build_vocabulary(df, "text")
    tokens = df.select(F.explode(F.split("text", " ")).alias("short"))
    kept = frequent_tokens(tokens, vocab.select(F.col("token").alias("short"), "token_id"), 3, 64).collect()
    assert len(kept) <= 3 and ("hot", 2) in [tuple(r) for r in kept]


def _graph(spark, edges, n):
    nodes = spark.range(n).select(F.col("id").alias("node"))
    e = spark.createDataFrame(edges, "src long, dst long")
    return nodes, G.undirected(e)


def test_neu_on_pair(spark):
    nodes, edges = _graph(spark, [(0, 1)], 2)
    vec = spark.createDataFrame([(0, [1.0]), (1, [3.0])], "node long, vec array<double>")
    r = {x.node: x.vec for x in G.neu_arrays(vec, edges, 0.5, 0.25).collect()}
    # normalised rows are 1 and 1; A R = 1; A^2 R = 1 -> 1 + 0.5 + 0.25
    assert abs(r[0][0] - 1.75) < 1e-12 and abs(r[1][0] - 1.75) < 1e-12


def test_neu_sends_no_vector_for_an_arc(spark):
    """Neighbours' means are summed in cells; an end without a vector counts neither in the sum nor in the mean."""
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(120)})
    nodes, edges = _graph(spark, [*pairs, (0, 99)], 30)
    vecs = {n: [rng.random(), rng.random() - 0.5] for n in range(30)}
    out = G.neu_arrays(spark.createDataFrame(list(vecs.items()), "node long, vec array<double>"), edges)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "flatmapgroupsinarrow" in plan and "summarizer" not in plan and "aggregate_metrics" not in plan
    near = {n: sorted({b for a, b in [*pairs, (0, 99)] if a == n != b} | {a for a, b in [*pairs, (0, 99)] if b == n != a}) for n in [*range(30), 99]}

    def mean(of):
        met = {n: [of[m] for m in near[n] if m in of] for n in near}
        return {n: [sum(x) / len(v) for x in zip(*v)] for n, v in met.items() if v}

    one = {n: [x / sum(y * y for y in v) ** 0.5 for x in v] for n, v in vecs.items()}
    a = mean(one)
    aa = mean(a)
    got = {r.node: r.vec for r in out.collect()}
    assert got.keys() == one.keys()
    for n, v in one.items():
        assert got[n] == pytest.approx([x + 0.5 * y + 0.25 * z for x, y, z in zip(v, a.get(n, [0, 0]), aa.get(n, [0, 0]))], abs=1e-12)
