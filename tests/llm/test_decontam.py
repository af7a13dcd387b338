import random
import time

from marlstone.llm import decontam


def norm(text):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text or "").split())


def fewest_edits(item, text):
    """Edit distance of the item to its nearest substring, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            x, y = norm(item), norm(text)
            k = len(x) * decontam.MAX_EDITS // 100
            if not x or not y:
                continue
            if len(x) >= decontam.Q:
                e = fewest_edits(x, y)
                if e <= k:
                    out.add((d, i, e))
            elif f" {x} " in f" {y} ":
                out.add((d, i, 0))
    return out


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é", "zz"])
    return "".join(t)


def test_against_plain_alignment(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(12, 40))) for i in range(12)] + [(12, "Two words"), (13, None), (14, " . "), (15, "x"), (16, "Ünïcode " * 12)]
    items.append((17, items[0][1]))
    docs = [(0, None), (1, ""), (2, "two  WORDS, again"), (3, items[0][1].upper()), (3, items[0][1].upper()), (None, "..." + items[1][1])]
    for n in range(60):
        i = rng.randrange(12)
        m = len(items[i][1])
        docs.append((100 + n, text(rng.randint(0, 30)) + "\n" + edited(rng, items[i][1], rng.randint(0, m * 10 // 100 + 1)) + " " + text(rng.randint(0, 30))))
    docs.append((99, items[3][1] + " " + edited(rng, items[3][1], 3) + text(500) + items[16][1]))
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, edits int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.find_overlaps(d, b).collect()]
    assert set(got) == brute(docs, items)
    assert got.count((3, 0, 0)) == 2
    hit = {r[0] for r in got}
    kept = [tuple(r)[:2] for r in decontam.remove_contaminated(d, b).collect()]
    assert sorted(kept, key=str) == sorted((r for r in docs if r[0] not in hit), key=str)


def test_blocks_and_empty(spark, monkeypatch):
    d = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank today")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "quick brown fox jumps over the lazy dog near"), (6, "nothing of the kind"), (7, "over the lazy dog near the river bank")], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 10)
    assert {r["item_id"] for r in decontam.find_overlaps(d, b).collect()} == {5, 7}
    assert decontam.find_overlaps(d, b.limit(0)).count() == 0
    assert decontam.find_overlaps(d.limit(0), b).count() == 0
    assert decontam.remove_contaminated(d, b.limit(0)).count() == 1
    assert decontam.remove_contaminated(d, b).count() == 0


def test_short_items_with_one_edit(spark):
    items = [(1, "abcde fghijkl"), (2, "abcde fghijklm"), (3, "abcde fghijklmn"), (4, "abcdefgh"), (5, "abcdefg"), (6, "qrstuvwxyz abc")]
    docs = [(1, "xx yy abcde fghXjkl zz"), (2, "abcdefghijkl"), (3, "Xabcde fghijkl"), (4, "abcde fgijklm abcdefg."), (5, "abcde fghijkXXmn"), (6, "uabcdefghu uabcdefgu"), (7, "qrstuvwxyzz abc")]
    rng = random.Random(9)
    for n in range(150):
        docs.append((10 + n, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9))) + edited(rng, rng.choice(items)[1], rng.randint(0, 3)) + " ab" * rng.randint(0, 3)))
    got = [tuple(r) for r in decontam.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert (1, 1, 1) in got and set(got) == brute(docs, items)


def test_repetitive_texts_take_linear_time(monkeypatch):
    rng = random.Random(2)
    block = decontam.Items([(i, "ab cd " * 38 + "".join(rng.choice("abcd ") for _ in range(12))) for i in range(50)])

    def took(n):
        began = time.perf_counter()
        found = block.hits(decontam.normal("ab cd " * n))
        return time.perf_counter() - began, found

    took(100)
    (short, a), (long, b) = took(2000), took(8000)
    assert a == b and long < 60 and long < 12 * max(short, 0.2)
    whole = decontam.Items([(1, "ab cd " * 40)]).hits(decontam.normal("ab cd " * 300))
    monkeypatch.setattr(decontam, "PAIRS", 64)
    assert decontam.Items([(1, "ab cd " * 40)]).hits(decontam.normal("ab cd " * 300)) == whole == [(1, 0)]
