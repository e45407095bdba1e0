import random
import unicodedata

from millrace.llm import leakage as L


def norm(x):
    return "".join(c for c in unicodedata.normalize("NFKC", x or "").lower() if unicodedata.category(c)[0] in "LN")


def runs(x):
    return {x[i : i + 8] for i in range(len(x) - 7)}


def brute(texts, questions):
    out = set()
    for k, t in enumerate(texts):
        own = runs(norm(t))
        for i, q in enumerate(questions):
            r = runs(norm(q))
            if r and 5 * len(r & own) >= 2 * len(r):
                out.add((k, i))
    return out


def case(seed, edge):
    r = random.Random(seed)
    phrase = ["应怎样把它写成矛盾之间的关系", "预算不超过", "which contradiction links ", "能否借助功能模型解决"]
    word = lambda: "".join(r.choice("郧澜宣莳湛蘅纨岐abcdef12") for _ in range(r.randint(2, 9)))
    questions = ["".join(r.choice([word(), r.choice(phrase)]) for _ in range(r.randint(3, 9))) for _ in range(120)] + ["短", None, ""]
    questions += [questions[0], questions[1] + "改"]
    texts = list(edge)
    for _ in range(300):
        parts = [word() for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(0, 2)):
            q = r.choice(questions) or ""
            a = r.randrange(len(q) + 1)
            piece = q[a : a + r.randint(5, 60)]
            parts.insert(r.randrange(len(parts) + 1), r.choice([piece, piece.upper(), " ".join(piece)]))
        texts.append("，".join(parts))
    return texts, questions


def test_search_equals_brute_force(edge_texts):
    for seed in range(4):
        texts, questions = case(seed, edge_texts)
        r, i, _, _ = L.ItemIndex([str(k) for k in range(len(questions))], questions, [None] * len(questions)).search(texts)
        assert set(zip(r, i)) == brute(texts, questions)
        assert len(r) == len(set(zip(r, i)))


def test_wand_equals_full_scoring(edge_texts):
    texts, questions = case(7, edge_texts)
    x = L.ItemIndex([str(k) for k in range(len(questions))], questions, [None] * len(questions))
    rng = random.Random(1)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(x.terms)), rng.randint(1, 60)))
        score = {}
        for t in terms:
            for p in range(x.first[t], x.first[t + 1]):
                score[x.item[p]] = score.get(x.item[p], 0) + x.impact[p]
        near = {i for i, s in score.items() if abs(s - 1) < 1e-9}
        assert set(x.wand(terms)) - near == {i for i, s in score.items() if s >= 1} - near


def test_blocks_of_items_and_tables(spark, edge_texts, monkeypatch):
    texts, questions = case(3, edge_texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(f"q{i}", q, "答案" * 9) for i, q in enumerate(questions)], "id string, question string, reference_answer string")
    want = {(k, f"q{i}") for k, i in brute(texts, questions)}
    assert {(r.row_id, r.item_id) for r in L.leaks(docs, items, "doc_id", "text").collect()} == want
    monkeypatch.setattr(L, "ITEMS", 40)
    assert {(r.row_id, r.item_id) for r in L.leaks(docs, items, "doc_id", "text").collect()} == want
    twice = items.union(items)
    got = [(r.row_id, r.item_id) for r in L.leaks(docs, twice.limit(10_000), "doc_id", "text").collect()]
    assert set(got) == want
    assert L.leaks(docs.where("false"), items, "doc_id", "text").count() == 0
    assert L.leaks(docs, items.where("false"), "doc_id", "text").count() == 0
