"""MinHash near duplicates and connected components against brute force."""

import itertools
import random

from linefold.llm.components import components
from linefold.llm.minhash import near_duplicates


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def expected(rows, width):
    sets = {i: shingle_set(t, width) for i, t in rows}
    links = [
        (a, b) for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return roots(sets, links), {i: len(s) for i, s in sets.items()}


def test_groups_of_copies_and_near_copies(spark, docs_of, prose):
    rng, texts = random.Random(5), prose(5, 12, 300, 400)
    rows = []
    for text in texts:
        words = text.split() + ["end"]
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, len(words) // 20])):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    component, sizes = expected(rows, 4)
    got = near_duplicates(docs_of(rows), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_in_which_not_all_are_alike(spark, docs_of):
    base = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join(base[:n % 30] + [f"z{n}"] + base[n % 30 :])) for n in range(80)]
    rows += [(100 + n, " ".join(base[: 12 + n])) for n in range(30)]
    component, _ = expected(rows, 5)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows)).collect()} == component


def test_odd_rows(spark, docs_of, odd_rows):
    got = near_duplicates(docs_of(odd_rows), width=4).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_shingles for i in (2, 3, 4)] == [0, 0, 0]
    assert all(by_id[i].component_id == i and by_id[i].kept for i in (2, 3, 4, 5, 6, 7))
    assert by_id[None].component_id is None and by_id[None].kept
    assert near_duplicates(docs_of([])).collect() == []


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, n) for n in range(201, 240)] + [(300, 300)]
    links += [(rng.randrange(400, 450), rng.randrange(400, 450)) for _ in range(30)]
    rng.shuffle(links)
    links = [rng.choice([(a, b), (b, a)]) for a, b in links]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for link in links if link[0] != link[1] for n in link}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ids_with_several_texts_keep_their_links(spark, docs_of):
    a = " ".join(f"w{i}" for i in range(60))
    near, other = a.replace("w59", "x"), " ".join(f"v{i}" for i in range(40))
    got = near_duplicates(docs_of([(5, a), (7, near), (5, other), (3, other)]), width=4).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (7, 3)}
