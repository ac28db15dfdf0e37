"""Nearest vectors and name variants: brute force, blocks, skew and edge cases."""

import random

import numpy as np
import pytest

pytest.importorskip("leafmill.llm")

from leafmill.llm import names, neighbours  # noqa: E402

VEC = "node_id long, vec array<float>, pages int"


def clustered(n=600, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    return np.repeat(centres, 6, axis=0) + 0.25 * rng.normal(size=(n // 6 * 6, dim))


def brute(x, k, floor):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    np.fill_diagonal(sim, -9)
    out = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-sim[i, j], j))[:k]:
            if sim[i, j] >= floor:
                out.add((min(i, j), max(i, j)))
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], VEC)


def test_recall_against_brute_force(spark):
    x = clustered()
    want = brute(x, 5, 0.88)
    got = {tuple(r) for r in neighbours.found(frame(spark, x)).collect()}
    assert len(want) > 500 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_blocks_change_nothing(spark):
    df = frame(spark, clustered(300))
    small = neighbours.most_similar(df, 5, 0.88, cap=8)
    whole = neighbours.most_similar(df, 5, 0.88)
    assert {tuple(r)[:2] for r in small.collect()} == {tuple(r)[:2] for r in whole.collect()}


def test_copies_ties_nulls_repeats(spark):
    one, two = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62
    rows = [(i, one, 0) for i in range(10)] + [(20, two, 0), (21, [2.0 * v for v in two], 0), (30, None, 0), (31, [0.0] * 64, 0), (0, one, 0), (None, one, 0), (32, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, VEC)
    x = np.array([one] * 10 + [two, two])
    ids = [*range(10), 20, 21]
    want = {(ids[a], ids[b]) for a, b in brute(x, 5, 0.88)}
    got = [tuple(r) for r in neighbours.found(df).collect()]
    assert set(got) == want and len(got) == len(set(got))
    assert neighbours.found(df.limit(0)).count() == 0
    assert neighbours.found(df.where("node_id = 20")).count() == 0


def at_cosines(cosines, dim=64, seed=3):
    """Two vectors of each cosine, side by side."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, len(cosines), dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = np.array(cosines)[:, None]
    return np.stack([a, c * a + np.sqrt(1 - c * c) * b], axis=1).reshape(-1, dim)


def test_recall_near_the_floor(spark):
    x = at_cosines(np.linspace(0.8805, 0.90, 800))
    got = {tuple(r) for r in neighbours.found(frame(spark, x)).collect()}
    want = {(2 * i, 2 * i + 1) for i in range(800)}
    assert not got - want and len(got) >= 0.93 * len(want)


@pytest.mark.parametrize("rows", [25_000, 2_500_000, 250_000_000])
def test_index_of_any_size_reaches_the_aim(rows):
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(4096, 64))
    index = neighbours.planned(sample / np.linalg.norm(sample, axis=1, keepdims=True), rows)
    assert rows / 2**index.bits <= neighbours.FILL
    for low, high, least in ((0.88, 0.90, 0.94), (0.90, 0.92, 0.96), (0.95, 1.0, 0.995)):
        x = at_cosines(rng.uniform(low, high, 4000))
        (wa, oa, pa), (wb, ob, pb) = (neighbours.codes_of(v, index) for v in (x[::2], x[1::2]))
        met = ((oa == ob) | (oa == pb) | (pa == ob)).any(axis=0) & (np.bitwise_count(wa ^ wb).sum(axis=1) <= index.radius)
        assert met.mean() >= least


def test_recall_without_a_floor(spark):
    x = clustered(600, seed=6)
    want = brute(x, 5, -1.0)
    best = neighbours.most_similar(frame(spark, x), 5, -1.0, aim=0.5)
    got = {tuple(r) for r in best.selectExpr("least(node, other)", "greatest(node, other)").distinct().collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_many_vectors_without_direction(spark):
    one = [1.0] + [0.0] * 63
    odd = [[0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, [None] + one[1:], [1.0, 2.0]]
    rows = [(100 * e + i, v, 0) for e, v in enumerate(odd) for i in range(9)] + [(900 + i, one, 0) for i in range(20)]
    got = {tuple(r) for r in neighbours.found(spark.createDataFrame(rows, VEC)).collect()}
    assert got == {(900 + a, 900 + b) for a, b in brute(np.array([one] * 20), 5, 0.88)}


def test_one_hot_cluster(spark):
    rng = np.random.default_rng(4)
    x = np.ones(64) + 0.02 * rng.normal(size=(120, 64))  # all in the same buckets
    got = {tuple(r) for r in neighbours.most_similar(frame(spark, x), 5, 0.88, cap=16).selectExpr("least(node, other)", "greatest(node, other)").distinct().collect()}
    want = brute(x, 5, 0.88)
    assert len(got & want) >= 0.97 * len(want)


NODE = "node_id long, doc_id string, page int, name string, type string, pages array<int>, degree int"

ENTITIES = [
    ["Philippa Trefengaldor", "Pippa Trefengaldor", "Trefengaldor, Philippa", "P. Trefengaldor", "PHILIPPA TREFENGALDOR", "Philippa Trefngaldor", "PhilippaTrefengaldor", "Dr. Philippa Trefengaldor", "Philippa M. Trefengaldor"],
    ["Hélène Trefengaldor", "Helene Trefengaldor", "Trefengaldor H."],
    ["Jürgen Badrazellor", "Juergen Badrazellor", "Mr Badrazellor"],
    ["Banatasel Society of Geology", "Banatasel Soc. of Geology", "The Banatasel Society of Geology", "Society of Geology, Banatasel", "Banatasel Soicety of Geolgy", "Banatasel Soc.", "BSOG"],
    ["Vinzequelvel Laboratory of Night Schools", "Vinzequelvel Lab Night Schools", "Vinzequelvel Laboratory of Nigh tSchools", "Vinz. Laboratory of Night Schools"],
    ["Vinzequelvel Laboratory of Hydrology", "Vinzequelvel Laboratory for Hydrology Ltd."],
    ["8 May 1604 (entry 1)"], ["8 May 1624 (entry 2)"], ["Norkel Harbour"],
]


def node_rows(doc, shift, seed):
    rng = random.Random(seed)
    flat = [(e, n) for e, group in enumerate(ENTITIES) for n in group]
    rng.shuffle(flat)
    return [(shift + i, doc, 1, n, "OTHER", [1], 0) for i, (_, n) in enumerate(flat)], {shift + i: (doc, e) for i, (e, _) in enumerate(flat)}


def test_names_by_entity(spark):
    rows, of = [], {}
    for d in range(6):  # words of organisations are common only over several jobs
        r, o = node_rows(f"d{d}", 1000 * d, d)
        rows += r
        of |= o
    # own words must not be common: each job has its own spelling of families
    rows = [(i, d, p, n.replace("ngaldor", f"ngald{'abcdef'[int(d[1])]}r").replace("NGALDOR", f"NGALD{'ABCDEF'[int(d[1])]}R").replace("tasel", f"tas{'abcdef'[int(d[1])]}l").replace("quelvel", f"quelv{'abcdef'[int(d[1])]}l").replace("zellor", f"zell{'abcdef'[int(d[1])]}r"), t, g, k) for i, d, p, n, t, g, k in rows]
    df = spark.createDataFrame([*rows, rows[0], (None, "d0", 1, "x", None, None, None), (99999, "d0", 1, None, None, None, None), (99998, "d0", 1, " ", None, None, None)], NODE)
    got = [tuple(r) for r in names.found(df).collect()]
    want = {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    assert len(got) == len(set(got)) and not set(got) - want
    assert len(want & set(got)) >= 0.9 * len(want)
    assert names.found(df.limit(0)).count() == 0


COMMON = [
    ["Philippa Smith", "Pippa Smith", "Smith, Philippa", "P. Smith", "PHILIPPA SMITH", "Philippa Smiht", "Smith Philippa"],
    ["Robert Smith", "Bob Smith", "Robbert Smith", "R. Smith"],
    ["Smith Society of Geology", "Smith Soc. of Geology", "Society of Geology, Smith"],
    ["Smith Society of Hydrology", "The Smith Society for Hydrology"],
]


def test_names_of_common_words(spark):
    rows, of = [], {}
    for d in range(6):  # each word is in every job, so that none is rare
        for i, (e, n) in enumerate((e, n) for e, group in enumerate(COMMON) for n in group):
            rows.append((100 * d + i, f"d{d}", 1, n, "OTHER", [1], 0))
            of[100 * d + i] = (d, e)
    rows += [(900, "d0", 1, "Xanthippe Smith", "OTHER", [1], 0), (901, "d0", 1, "X. Smith", "OTHER", [1], 0)]
    of |= {900: (0, 9), 901: (0, 9)}  # a rare given name beside a common family
    got = {tuple(r) for r in names.found(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {(a, b) for a in of for b in of if a < b and of[a] == of[b]}


def test_names_of_short_words(spark):
    groups = [["Jane Lee", "J. Lee", "Lee, Jane", "JANE LEE"], ["Jane Lea"], ["Kim Ng", "Ng, Kim", "Kím Ng"], ["Ann Wu", "Wu, A."], ["Lee Bank of Tea", "Lee Bk. of Tea"], ["王小明", "王 小明"]]
    rows = [(100 * d + 10 * e + i, f"d{d}", 1, n, "OTHER", [1], 0) for d in range(6) for e, g in enumerate(groups) for i, n in enumerate(g)]
    got = {tuple(r) for r in names.found(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[0] // 10 == b[0] // 10}


def found_in(spark, names_, doc="d"):
    """Groups of names that are linked in one job."""
    df = spark.createDataFrame([(i, doc, 1, n, "OTHER", [1], 0) for i, n in enumerate(names_)], NODE)
    return {(names_[a], names_[b]) for a, b in (tuple(r) for r in names.found(df).collect())}


def test_many_names_of_one_family(spark):
    rng = random.Random(5)
    given = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(60)]
    flat = [f"{g.title()} Smith" for g in given] + [f"{g[1:].title()} Smith" for g in given] + ["Philippa Smith", "Pippa Smith"]
    assert found_in(spark, flat) == {(flat[i], flat[60 + i]) for i in range(60)} | {("Philippa Smith", "Pippa Smith")}


def test_index_finds_what_all_pairs_find(spark):
    rng = random.Random(8)
    base = [f"{g} {f}" for g in ("Robert", "Rosa", "Philippa", "Anna Maria", "Maria") for f in ("Norvelmar", "Norvelnar", "Kim")]
    base += [f"{o} {k} of {f}" for o in ("Tasmerel", "Tasmorel") for k in ("Society", "Bank") for f in ("Geology", "Night Schools", "Rope and Timber")]

    def typo(n):
        i = rng.randrange(len(n) - 1)
        return rng.choice([n, n.upper(), n[:i] + n[i + 1 :], n[:i] + n[i + 1] + n[i] + n[i + 2 :], n[:i] + rng.choice("aeiou") + n[i + 1 :]])

    flat = [(i, typo(rng.choice(base))) for i in range(160)]
    got = {tuple(r) for r in names.found(spark.createDataFrame([(i, "d", 1, n, "OTHER", [1], 0) for i, n in flat], NODE)).collect()}
    full = {i for i, n in flat if (r := names.read(n)) and r.sort == "full"}
    assert {p for p in got if set(p) <= full} == names.pairs_of(flat)


def test_spellings_two_steps_from_the_word(spark):
    chain = ["Robert Norvelmar", "Robert Norvelmr", "Robert Norvlmr", "Rosa Norvelmar"]
    got = found_in(spark, chain)
    assert got == {(chain[a], chain[b]) for a in range(3) for b in range(a + 1, 3)}


def test_numbers_and_misread_digits(spark):
    flat = ["Studio Hall 54", "STUDIO HALL 54", "Studio Hall 45", "R0bert Norvelmar", "Robert Norvelmar", "8 May 1604 (entry 1)", "8 May 1604 (entry 2)"]
    assert found_in(spark, flat) == {("Studio Hall 54", "STUDIO HALL 54"), ("R0bert Norvelmar", "Robert Norvelmar")}


def test_several_given_names_and_initials(spark):
    flat = ["Anna Maria Norvelmar", "Anna M. Norvelmar", "Anna Louise Norvelmar", "Norvelmar, A. M."]
    got = found_in(spark, flat)
    assert ("Anna Maria Norvelmar", "Anna M. Norvelmar") in got and not any("Louise" in x for p in got for x in p)
    assert found_in(spark, ["Robert Norvelmar", "R. Norvelmar", "Rosa Kimmel", "Kimmel, R. S.", "Mr Kimmel"]) == {("Robert Norvelmar", "R. Norvelmar"), ("Rosa Kimmel", "Kimmel, R. S."), ("Rosa Kimmel", "Mr Kimmel"), ("Kimmel, R. S.", "Mr Kimmel")}


def test_very_long_names(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{'x' * (i % 7)}" for i in range(3000))
    assert found_in(spark, [long, long.upper(), long + " more"]) == {(long, long.upper())}


def test_variants_of_names_of_many_words(spark):
    pablo = "Pablo Diego Jose Francisco Juan Nepomuceno Crispin Cipriano Santisima Trinidad Ruiz Picasso"
    animals = "Kelmar Royal Society for the Prevention of Cruelty to Animals and Other Living Creatures"
    groups = [
        [pablo, pablo.replace("Nepomuceno", "Nepomuzeno"), pablo.replace("Trinidad ", ""), "Pablo Picasso", "P. Picasso", "Picasso, Pablo Ruiz"],
        ["Maria Diego Jose Francisco Juan Nepomuceno Crispin Cipriano Santisima Trinidad Ruiz Norvel"],
        [animals, animals.replace("Society", "Soc."), animals.replace("Cruelty", "Crulety"), animals.replace("Other Living", "OtherLiving"), "KSRPCTAOLC"],
        [animals.replace("Animals", "Children")],
    ]
    of = {n: k for k, g in enumerate(groups) for n in g}
    flat = [n for g in groups for n in g]
    assert found_in(spark, flat) == {(a, b) for i, a in enumerate(flat) for b in flat[i + 1 :] if of[a] == of[b]}


def test_variants_of_running_text(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(80)]

    def changed(*at):
        return " ".join(w[:1] + w[2:] if len(w) > 3 and i in at else w for i, w in enumerate(text))

    long = [i for i, w in enumerate(text) if len(w) > 4]
    one = [" ".join(text), changed(*long[:3]), changed(*long[5:8]), " ".join(text[:9]) + "".join(text[9:30]) + " " + " ".join(text[30:]), " ".join(["the", *text[::-1]])]
    other = [changed(*long[10:15]), " ".join(text[:-1]), " ".join(["norvelmar", *text])]
    got = found_in(spark, [*one, *other])
    assert got == {(a, b) for i, a in enumerate(one) for b in one[i + 1 :]}
    # all pairs, by definition
    flat = [changed(*rng.sample(long, rng.randrange(4))) for _ in range(60)]
    reads = [names.read(n) for n in flat]
    m = names.Meeting([])
    m.parent = {i: i for i in range(60)}
    for i in range(60):
        for j in range(i):
            if names.alike(reads[i], reads[j]):
                m.join(i, j)
    df = spark.createDataFrame([(i, "d", 1, n, "OTHER", [1], 0) for i, n in enumerate(flat)], NODE)
    assert {tuple(r) for r in names.found(df).collect()} == {(i, j) for j in range(60) for i in range(j) if m.find(i) == m.find(j)}


def test_names_without_a_common_word_or_initial_meet(spark):
    pairs = [("Bob Jim", "Robert James"), ("Obert Nelvormith", "Robert Melvormith"), ("Dann Quelvor", "Ann Quelvor"), ("Tasmerel Bank of Geology", "Tasme Bank of Geol."), ("Kel Bank of Tea", "Kelm Bank of Teak")]
    pairs += [("Norvelmar Norvelmar", "Tasmezel Norvelmar Norvelmar"), ("Yarta Night Society of Rope Maker", "Yartanight Society of Ropemaker")]
    for a, b in pairs:
        assert names.aligned(names.read(a), names.read(b))
    assert found_in(spark, [n for p in pairs for n in p]) == set(pairs)


def test_within_two_by_definition():
    rng = random.Random(7)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randrange(9))]
        b = a.copy()
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + 2] = rng.choice([b[i : i + 2][::-1], b[i : i + 1], [rng.choice("abcd"), *b[i : i + 2]], [rng.choice("abcd")]])
        a, b = "".join(a), "".join(b)
        want = names.near(a, b) or abs(len(a) - len(b)) < 3 and any(names.near(x, y) for x in names.deletes(a) for y in names.deletes(b))
        assert names.within_two(a, b) == want


def test_words_and_distances():
    assert names.words("Łukasz O. NELRA") == ["lukasz", "o", "nelra"] and names.words("RobertYarta") == ["robert", "yarta"]
    assert names.near("abcd", "abdc") and names.near("abcd", "abd") and not names.near("abcd", "badc")
    assert names.same_given("pippa", "philippa") and names.same_given("robert", "rbert") and not names.same_given("robert", "rupert")
    assert names.aligned(names.read("Kor Society of Night Schools"), names.read("Kor Soc. of Nigh tSchools")) and not names.aligned(names.read("Kor Society of Geology"), names.read("Kor Society of Hydrology"))
    rng = random.Random(2)
    for _ in range(300):  # one edit always shares a form with one letter left out, and an end
        w = "".join(rng.choice("abcde") for _ in range(rng.randrange(4, 9)))
        i = rng.randrange(len(w))
        e = rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
        assert names.near(w, e)
        if len(e) > 3:
            assert set(names.deletes(w)) & set(names.deletes(e))
            assert w[:2] == e[:2] or w[-2:] == e[-2:] or len(w) == len(e) == 4 and w[0] + w[-1] == e[0] + e[-1]


@pytest.mark.parametrize("n", [2, 5])
def test_ambiguous_short_forms_stay_alone(spark, n):
    assert found_in(spark, ["Robert Nelvor", "Rosa Nelvor", "R. Nelvor", "Mr Nelvor"][:n]) == set()


def test_components_of_chains(spark):
    rng = random.Random(3)
    order = rng.sample(range(200), 200)
    links = [(max(a, b), min(a, b)) for a, b in zip(order[:99], order[1:100], strict=True)] + [(max(a, b), min(a, b)) for a, b in zip(order[100:150], order[101:151], strict=True)]
    got = {r["node"]: r["entity"] for r in names.components(spark.createDataFrame(links, "a long, b long")).collect()}
    one, two = order[:100], order[100:151]
    assert got == {n: min(c) for c in (one, two) for n in c if n != min(c)}
