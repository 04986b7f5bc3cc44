import random
from itertools import combinations

import pytest
from conftest_llm import ODD

from vigil.llm import line_dedup
from vigil.llm.queries import QUERIES


def patience(a, b):
    """Equal places of two lists in order, written by recursion apart from the operator's."""

    def solve(i, k, j, m):
        head = 0
        while i + head < k and j + head < m and a[i + head] == b[j + head]:
            head += 1
        out = [(i + x, j + x) for x in range(head)]
        i, j = i + head, j + head
        tail = 0
        while k - tail > i and m - tail > j and a[k - tail - 1] == b[m - tail - 1]:
            tail += 1
        out += [(k - x - 1, m - x - 1) for x in range(tail)]
        k, m = k - tail, m - tail
        once = [x for x in range(i, k) if a[x] is not None and a[i:k].count(a[x]) == 1 and b[j:m].count(a[x]) == 1]
        best = []  # longest rising run by plain dynamic programming, the operator's choice among equals
        places = [b.index(a[x], j, m) for x in once]
        tops, back = [], []
        for n, y in enumerate(places):
            pile = sum(places[t] < y for t in tops)
            back.append(tops[pile - 1] if pile else None)
            tops[pile: pile + 1] = [n]
        n = tops[-1] if tops else None
        while n is not None:
            best.append((once[n], places[n]))
            n = back[n]
        best.reverse()
        if best:
            edges = [(i - 1, j - 1), *best, (k, m)]
            out += best
            for (p, q), (r, t) in zip(edges, edges[1:]):
                out += solve(p + 1, r, q + 1, t)
        return out

    return sorted(solve(0, len(a), 0, len(b)))


def blocks(pairs):
    out = []
    for p in pairs:
        if out and out[-1][-1] == (p[0] - 1, p[1] - 1):
            out[-1].append(p)
        else:
            out.append([p])
    return out


def removed_by_brute_force(rows, min_chars=40, rare=8):
    """Lines that go, by id and text: alignments with every earlier document that shares a line, and runs that many documents have."""
    docs = {(10**18 if i is None else i, t or "") for i, t in rows}
    lines = {d: [x if x.strip(" \t\n\x0b\x0c\r") else None for x in d[1].split("\n")] for d in docs}
    size = lambda some: sum(len(x) for x in some if x)
    gone = {d: set() for d in docs}
    holders = {}
    for d, own in lines.items():
        for i in range(len(own)):
            for k in range(i + 1, len(own) + 1):
                if size(own[i:k]) >= min_chars and (size(own[i + 1: k]) < min_chars or size(own[i: k - 1]) < min_chars):
                    # Minimal at one end: a line less there is too short.
                    holders.setdefault(tuple(own[i:k]), {}).setdefault(d, []).append((i, k))
    for run, have in holders.items():
        if len(have) > rare:
            least = min(d[0] for d in have)
            for d, places in have.items():
                if d[0] > least:
                    for i, k in places:
                        gone[d] |= {*range(i, k)}
    for later in docs:
        for earlier in docs:
            if earlier[0] < later[0] and {*lines[later]} & {*lines[earlier]} - {None}:
                for block in blocks(patience(lines[later], lines[earlier])):
                    if size(lines[later][i] for i, _ in block) >= min_chars:
                        gone[later] |= {i for i, _ in block}
    return {d: sorted(g) for d, g in gone.items()}


def check(df, rows):
    want = removed_by_brute_force(rows)
    got = df.select("doc_id", "text", "removed", "n_lines", "n_removed").collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        match = []
        for t in texts[r["doc_id"]]:
            gone = want[(10**18 if r["doc_id"] is None else r["doc_id"], t or "")]
            rest = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone) if gone else t
            match.append((rest, gone, len(t.split("\n")) if t else 0, len(gone)))
        assert (r["text"], r["removed"], r["n_lines"], r["n_removed"]) in match


def test_random_documents(make):
    rng = random.Random(4)
    pool = [f"this is line number {k} and it is long enough" for k in range(30)] + ["short", "", " ", "tiny one"]
    rows = [(i, "\n".join(rng.choice(pool[:10] if rng.random() < 0.3 else pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    check(line_dedup.dedup_lines(make(rows)), rows)


def test_frequent_lines_lose_no_block(make):
    """A first holder with its lines in another order, short lines with different first holders, and a run that all have."""
    shout = ["first line of the block", "second one of it", "third", "fourth of the block"]
    rows = [(0, "\n".join(reversed(shout))), (1, "\n".join(shout[:2] + ["x"] + shout[2:]))]
    rows += [(k, "\n".join([f"own {k}", *shout, f"end {k}", "", "license text that every document carries, word by word"])) for k in range(2, 40)]
    rows += [(40 + k, "\n".join([shout[1], shout[0], f"line {k} of a kind that is longer than forty characters", shout[3]])) for k in range(20)]
    check(line_dedup.dedup_lines(make(rows)), rows)


def test_odd_rows(odd, clashing):
    rows = [(r[0], r[1]) for r in ODD]
    check(line_dedup.dedup_lines(odd), rows)
    df = line_dedup.dedup_lines(clashing)
    check(df, rows)
    assert df.select("bucket", "mix_slot", "id").distinct().collect() == [("own", "own", "own")]


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")), rows)
    assert QUERIES["op2_line_dedup"](spark, sf_dir).agg({"n_removed": "sum"}).first()[0] > 0


def test_a_moved_block_is_not_aligned_but_both_neighbours_are():
    a, b = list("abcdefgh"), list("efghabcd")
    assert line_dedup.align(a, b) in ([(i, i + 4) for i in range(4)], [(i + 4, i) for i in range(4)])


@pytest.mark.parametrize("seed", range(30))
def test_alignment_is_in_order_and_between_equal_lines(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice([*"abcdefg", None]) for _ in range(rng.randint(0, 15))] for _ in range(2))
    pairs = line_dedup.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < l for (i, j), (k, l) in zip(pairs, pairs[1:]))
    # Patience: lines unique in both are aligned as many as any order-keeping choice allows.
    unique = [(a.index(x), b.index(x)) for x in {*a} & {*b} - {None} if a.count(x) == 1 == b.count(x)]
    longest = max((n for n in range(len(unique) + 1) if any(all(p[1] < q[1] for p, q in zip(c, c[1:])) for c in combinations(sorted(unique), n))), default=0)
    assert len(pairs) >= longest


def test_an_empty_table(make):
    assert line_dedup.dedup_lines(make([])).count() == 0
