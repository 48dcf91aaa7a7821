import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import chat_format, components, decontam, line_dedup, ngram_join, pii, quality_rules, secrets, sentencepiece_sa, suffix_dedup, url_filter
from foliospark.llm.queries import tokenizer_file

from . import brute

DOCS = "doc_id long, text string, source string, lang string, kept string, ids string, lines string, block string, flags string, _h string, gone string, _id string, _whole string, n_lines string, _word_hashes string, _filled_lines string, _pii string, n_words string"


def corpus(n=60, seed=3):
    """Texts with exact and near copies, shared passages, repeats, nulls, empty ones and long ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    text = lambda k: "\n".join(" ".join(rng.choices(vocab, k=rng.randrange(1, 12))) for _ in range(k))
    passage, out = text(6), []
    for i in range(n):
        kind = rng.randrange(8)
        if kind == 0 and out:
            t = rng.choice(out)
        elif kind == 1 and out and (base := rng.choice(out)):
            w = base.split(" ")
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind == 2:
            t = text(3) + "\n" + passage + "\n" + text(2)
        elif kind == 3:
            t = rng.choice([None, "", " \n ", "one", "Ümläut ✓ 😀 " * 9, "a" * 400, "ab " * 100])
        else:
            t = text(rng.randrange(1, 25))
        out.append(t)
    return [(i * 3, t) for i, t in enumerate(out)]


def frame(spark, docs):
    """A table with columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, f"s{d % 3}" if d is not None and d % 5 else None, "en", *"kilbfhgdwnpqrs") for d, t in docs], DOCS)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_ngram_groups(spark, docs):
    for n, num in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(frame(spark, docs), n, num, 100).collect()}
        assert got == brute.jaccard_groups(docs, n, num, 100)


def test_ngram_groups_do_not_depend_on_buckets(spark, docs):
    want = brute.jaccard_groups(docs, 3, 80, 100)
    for bucket_bytes, bin_bytes in ((2_000, 1_000), (100, 1 << 30), (1 << 30, 100)):
        out = ngram_join.jaccard_groups(frame(spark, docs), 3, 80, 100, bucket_bytes=bucket_bytes, bin_bytes=bin_bytes)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == want


def test_ngram_groups_of_nothing(spark):
    df = frame(spark, [(1, None), (2, ""), (None, "a b c")])
    assert sorted(map(tuple, ngram_join.jaccard_groups(df).collect())) == [(1, 0, 1), (2, 0, 2)]
    assert ngram_join.jaccard_groups(df.limit(0)).collect() == []


def test_ngram_groups_take_any_id_and_equal_sets(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = [((1 << 62) + 5, text), (-(1 << 62), text + " end"), (-3, text), (7, "w1 w2"), ((1 << 62) + 6, "W1\tw2"), (8, "w2 w1"), (9, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(frame(spark, docs), 3, 90, 100).collect()}
    assert got == brute.jaccard_groups(docs, 3, 90, 100)


def test_every_pair_of_chunks_meets_once():
    counts = {0: 2, 1: 3, 2: 0, 3: 1, 4: 4}
    tasks = {}
    for c, own in counts.items():
        for chunk in range(own):
            for step, tree, task, inside in ngram_join.trees_of(chunk, counts.get(c - 1, 0), own, counts.get(c + 1, 0)):
                tasks.setdefault((c + step, tree, task), ([], []))[0 if inside else 1].append((c, chunk))
    met = [frozenset([a, b]) for (_, _, task), (tree, walkers) in tasks.items() for k, a in enumerate(tree) for b in walkers + (tree[k:] if task == 0 else [])]
    every = [(c, k) for c, own in counts.items() for k in range(own)]
    assert sorted(map(sorted, met)) == sorted(map(sorted, {frozenset([a, b]) for a in every for b in every if abs(a[0] - b[0]) <= 1}))


def test_large_blocks_are_dealt_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_NGRAMS", 300)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    docs = [(i, " ".join(w if rng.random() > 0.01 else "x%d" % rng.randrange(9) for w in base)) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(frame(spark, docs), 3, 80, 100).collect()}
    assert got == brute.jaccard_groups(docs, 3, 80, 100)


def test_prefix_tree_finds_what_links_connect():
    rng = np.random.default_rng(0)
    for _ in range(30):
        base = np.unique(rng.integers(0, 10**9, 60)).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(0, 10**9, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(20)]
        up = list(range(20))

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        home = dict(enumerate(sets[:12]))
        counts = rng.integers(0, 9, ngram_join.CELLS)
        links = ngram_join.join_cell(home, dict(enumerate(sets[12:], 12)), True, 70, 100, counts)
        for a, b in links + ngram_join.join_cell(dict(enumerate(sets[12:], 12)), {}, True, 70, 100, counts):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both)
            up[top(a)] = top(b)
        for a in range(20):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both):
                    assert top(a) == top(b)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(20)] + [(7, 7)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + k: 100 for k in range(20)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_suffix_dedup(spark, docs):
    for length in (50, 21):
        out = suffix_dedup.remove_repeats(frame(spark, docs), length)
        got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), r.h) for r in out.withColumn("h", F.sha2("kept", 256)).collect()}
        assert got == brute.repeats(docs, length)


def test_suffix_dedup_does_not_depend_on_its_buckets(spark, docs):
    want, got = (sorted((r.doc_id, r.kept) for r in suffix_dedup.remove_repeats(frame(spark, docs), **more).collect()) for more in ({}, {"bucket_bytes": 700}))
    assert got == want


def test_suffix_dedup_sends_few_bytes_a_name():
    rng = np.random.default_rng(5)
    ids = np.sort(np.concatenate([[-(2**63), -7, -7, 0, 2**63 - 1], rng.integers(0, 10**6, 400)]))
    owner = np.sort(rng.integers(0, len(ids), 2000))
    head, tail = (rng.integers(0, 2**63, 2000).astype(np.uint64) for _ in range(2))
    for some in (slice(0, 1), slice(100, 1900), slice(0, 2000)):
        got = suffix_dedup._unpacked(suffix_dedup._packed(ids, owner[some], head[some], tail[some]))
        low = lambda x, n: x & np.uint64(256**n - 1)
        assert [g.tolist() for g in got] == [low(head[some], suffix_dedup.HEAD).tolist(), low(tail[some], suffix_dedup.WIDTH).tolist(), ids[owner[some]].tolist()]
    # ids that lie close take few bytes: two numbers a name and little else
    near = np.arange(10**12, 10**12 + 4000)
    data = suffix_dedup._packed(near, np.repeat(np.arange(1000), 2), head, tail)
    assert len(data) < 12 * 2000


def test_plain_prefix_doubling_agrees(spark, docs):
    docs = [(d, t) for d, t in docs if len(t or "") < 1500][:25]
    found = {(r.doc_id, r.pos) for r in suffix_dedup.doubling_ranks(frame(spark, docs), 50).collect()}
    spans = {r.doc_id: [(x.start, x.end) for x in r.removed] for r in suffix_dedup.remove_repeats(frame(spark, docs), 50).collect()}
    for d, t in docs:
        covered = sorted({k for e, pos in found if e == d for k in range(pos, pos + 50)})
        assert covered == [k for s, e in spans[d] for k in range(s, e)]
    assert found


def test_suffix_dedup_of_odd_rows(spark):
    t = "0123456789" * 8
    got = suffix_dedup.remove_repeats(frame(spark, [(None, t), (5, t), (5, t), (6, t), (7, None)])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, len(r.kept)) for r in got) == [(-1, 80), (5, 80), (5, 80), (6, 0), (7, 0)]
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_line_dedup(spark, docs):
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup.drop_common_blocks(frame(spark, docs)).collect()}
    assert got == brute.common_blocks(docs)


def test_line_dedup_of_odd_rows(spark):
    line = "these are four words"
    got = line_dedup.drop_common_blocks(frame(spark, [(None, line), (1, line), (2, line + "\nrest"), (2, line + "\nrest"), (3, None)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text is not None) == [(0, line), (1, line), (2, "rest"), (2, "rest")]
    assert line_dedup.drop_common_blocks(frame(spark, [])).collect() == []


def test_line_dedup_loses_no_block_of_any_pair(spark):
    block = ["the first line of it", "", "the second line of it", "}", "the third line of it"]
    docs = [(1, "\n".join(["a", *block[::-1]])), (2, "\n".join(["b", *block, "end"])), (3, "\n".join(["c", *block, "end"])), (4, "\n".join([*block, *block, "}"]))]
    got = {r.doc_id: r.text for r in line_dedup.drop_common_blocks(frame(spark, docs)).collect()}
    assert got[3] == "c" and got == {d: t for d, (t, _) in brute.common_blocks(docs).items()}
    rng = random.Random(11)
    lines = ["", "}", "x", *[f"telling line {k} here" for k in range(6)]]
    docs = [(d, "\n".join(rng.choices(lines, k=rng.randrange(1, 12)))) for d in range(120)]
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup.drop_common_blocks(frame(spark, docs)).collect()}
    assert got == brute.common_blocks(docs)


def test_patience_anchors_on_unique_lines():
    assert line_dedup.patience([1, 2, 3, 9, 5], [7, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert line_dedup.patience([1, 1], [1]) == [(0, 0)]


def test_decontamination_is_exact_on_candidates_and_reaches_recall(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(15, 50)))) for i in range(25)]
    docs, clean = [], []
    for k in range(150):
        around = lambda: " ".join(rng.choices(vocab, k=60))
        w = items[k % 25][1].split(" ")
        for _ in range(int(len(w) * rng.choice([0, 0, 0.05, 0.1]))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((k, around() + " " + " ".join(w) + ". " + around()))
        clean.append((1000 + k, around() + around()))
    got = decontam.find_items(frame(spark, docs + clean + [(5000, None), (5001, "")]), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")).collect()
    words = {i: decontam.words_of(t) for i, t in items}
    want = {(d, i): hit[0] for d, t in docs + clean for i, _ in items if (hit := decontam.edit_hits(words[i], decontam.words_of(t), int(0.2 * len(words[i]))))}
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    assert all(want[k] == v for k, v in found.items())
    assert len(found) >= 0.95 * len(want)
    assert not any(d >= 1000 for d, _ in found)


def test_edit_hits_against_a_table():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(1, 4, rng.integers(1, 12)), rng.integers(1, 4, rng.integers(0, 30))
        row = list(range(len(a) + 1))
        best = None
        for j, x in enumerate(b.tolist(), 1):
            new = [0]
            for i, y in enumerate(a.tolist(), 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != y)))
            row = new
            if row[-1] <= 3 and (best is None or row[-1] < best[0]):
                best = (row[-1], j)
        assert decontam.edit_hits(a.astype(np.uint64), b.astype(np.uint64), 3) == best


def test_sentencepiece_equals_the_model(spark):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(0)
    texts = ["Hello  world\n a", "  lead", "tab\there", "é ñ 漢 😀 a", "", "a ", "▁x", "\x00a\x00\x00b", "x" * 300, "    " * 30 + "y", "internationalization " * 3, None]
    texts += ["".join(rng.choice("abcdeinstrlo  ▁\n\té漢.,0123THE") for _ in range(rng.randrange(60))) for _ in range(400)]
    out = sentencepiece_sa.round_trip(sentencepiece_sa.decode_ids(sentencepiece_sa.encode(frame(spark, list(enumerate(texts))), model), model)).collect()
    for r in out:
        assert r.round_trip
        assert r.ids == (None if texts[r.doc_id] is None else sp.encode(texts[r.doc_id]))
    again = sentencepiece_sa.encode(frame(spark, list(enumerate(texts))), model, verify=True).collect()
    assert all(r.round_trip for r in again) and {r.doc_id: r.ids for r in again} == {r.doc_id: r.ids for r in out}
    assert sentencepiece_sa.encode(frame(spark, []), model).collect() == []


def test_secrets(spark):
    live, shared = "k9Xz81Lm20QrTy66PoWs4", "Zq81Lm20QrTy66PoWs4k9X"
    rows = [(1, f"token=token: abcdefg {live} x"), (2, "API_KEY: 'a1b2c3d4' AKIA" + "Z9" * 10), (4, "é 0123456789abcdef01234567 " + shared), (7, shared), (8, None), (11, ""), (12, 'PassWord = "x.y/z=-1"')]
    out = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows)).withColumn("b", secrets.written("base")).withColumn("s", secrets.written("spans")).collect()}
    import hashlib

    for d, t in rows:
        count = lambda kind, d=d: sum(x.kind == kind for x in out[d].base)
        assert (count("assign"), count("access"), count("hex"), hashlib.sha256(out[d].b.encode()).hexdigest()) == brute.secrets(t)
    assert "owned:21:42" in out[1].s
    assert "owned" in out[4].s and out[4].s == "hex:2:26,owned:27:49"  # both holders are source s1
    assert secrets.scan_secrets(frame(spark, [])).collect() == []


def test_secrets_that_many_own_are_examples(spark):
    token = "Zq81Lm20QrTy66PoWs4k9X"
    df = spark.createDataFrame([(k, f"a {token} b", f"s{k}", "en") for k in range(3)], "doc_id long, text string, source string, lang string")
    assert all(r.spans == [] for r in secrets.scan_secrets(df).collect())


def test_quality_statistics(spark, docs):
    more = [(9001, "a b c d e f a b c d e f g"), (9002, "x y\nx y\n\n x y\n# | <b>"), (9003, "a b c d e " * 400)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.apply_rules(frame(spark, docs + more), []).collect()}
    assert got == {d: brute.statistics(t) for d, t in docs + more}


def test_rules_generalise():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 5] > 0.7) & (x[:, 1] < 0.4))
    rules = quality_rules.learn(x[:2000], bad[:2000])
    hit = np.zeros(1000, bool)
    for r in rules:
        hit |= quality_rules._fits(r, x[2000:])
    assert (hit == bad[2000:]).mean() > 0.97
    assert quality_rules.learn(x, np.zeros(3000, bool)) == []
    assert quality_rules.rejects([]) == "0"


def test_quality_filter_keeps_clean_documents(spark):
    good = [(k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(40)]
    junk = [(100 + k, " ".join(f"w{k}##{i}" for i in range(40))) for k in range(40)]
    df = frame(spark, good + junk + [(500, None)])
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good[:30]] + [(k, 0, 0) for k, _ in junk[:30]] + [(1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(df, labels)
    assert {r.doc_id for r in quality_rules.keep_only(df, rules).collect()} == {k for k, _ in good}
    assert quality_rules.fit(df, labels.limit(0)) == []


def test_chat_keeps_maximal_conversations(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 5, "user", "a"), (4, 0, "user", "a"), (4, 1, "bot", "b"), (4, 2, "user", "c"), (5, 0, "user", None), (6, 0, "user", ""), (None, 0, "user", "z"), (7, 0, "user", "a"), (7, 1, None, "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.rendered for r in chat_format.collapse_and_render(df).collect()}
    assert sorted(got) == [2, 5, 6, 7]
    assert got[2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert chat_format.collapse_and_render(df.limit(0)).collect() == []


def test_url_rules_and_hosts(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://b.net/en/", "http://x.org/fr/1#t", "http://c.example.com/de", "http://c.example.com/de/1", "nothing", None, "://", "http://net", "ftp://q.net?x/en/"]
    pages = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("b.net", "/en/", "net/", "block")
    assert got[2] == ("x.org", "/fr/1", "org/fr/", "allow")
    assert got[3][:3] == ("c.example.com", "/de", None)
    assert got[4] == ("c.example.com", "/de/1", "example.com/de/", "block")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8][:3] == ("net", "", None) and got[9][:3] == ("q.net", "", None)


def test_distrust_flows_against_links(spark):
    link = lambda h: f'<a class="x" href="https://{h}/p">x</a>'
    rows = [(0, "http://bad.example.com/de/1", None), (1, "http://farm.org/en/1", link("bad.example.com") * 3), (2, "http://good.org/fr/1", link("friend.org")), (3, "http://friend.org/x", None), (4, "http://bad.example.com/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, threshold=0.3).collect()}
    assert got[1].verdict == "block" and got[1].distrust > 0 and got[4].verdict == "block"
    assert got[3].verdict == "allow" and got[3].trust > 0


def plain_scores(judged, links, rounds=12, damping=85):
    """host -> (trust, distrust), by a plain loop in whole numbers."""
    one, hosts = url_filter.ONE, sorted({h for h, _ in judged})
    out = {h: [] for h in hosts}
    for verdict, turn in (("allow", lambda a, b: (a, b)), ("block", lambda a, b: (b, a))):
        edges = {}
        for a, b in links:
            if a != b and a != "":
                edges.setdefault(turn(a, b)[0], []).append(turn(a, b)[1])
        of = {h: [v for x, v in judged if x == h] for h in hosts}
        base = {h: of[h].count(verdict) * one // len(of[h]) * (100 - damping) // 100 for h in hosts if verdict in of[h]}
        score = dict(base)
        for _ in range(rounds):
            new = dict(base)
            for src, targets in edges.items():
                for dst in set(targets):
                    share = targets.count(dst) * one // len(targets)
                    new[dst] = new.get(dst, 0) + score.get(src, 0) * share * damping // (100 * one)
            score = new
        for h in hosts:
            out[h].append(score.get(h, 0) * 100 // (100 - damping))
    return {h: tuple(v) for h, v in out.items()}


def test_propagation_on_a_random_graph(spark):
    """Fifty hosts with hubs, dangling hosts, hosts without pages and repeated links, against the plain loop and the SQL."""
    import duckdb

    from foliospark.llm import oracles

    rng = random.Random(31)
    hosts = [f"h{k}.{rng.choice(['net', 'org', 'example.com'])}" for k in range(45)]
    names, rows, links = [*hosts, *(f"nopage{k}.io" for k in range(5))], [], []
    for k in range(260):
        host = hosts[min(int(rng.expovariate(0.12)), 44)]
        targets = rng.choices(names, k=rng.randrange(5)) if host not in hosts[10:16] else []
        html = "<p>" + "".join(f"<A href='//{t.upper()}/x'>y</A><a href='/own'>" for t in targets)
        rows.append((k, f"http://{host}/{rng.choice(['fr', 'en', 'de'])}/{k}", html if rng.random() < 0.9 or targets else None))
        links += [(host, t) for t in targets]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    judged = [(r.host, r.verdict if r.rule else None) for r in got]
    want = plain_scores(judged, links)
    assert {r.host: (r.trust, r.distrust) for r in got} == want and sum(min(v) > 0 for v in want.values()) > 20
    open_hosts = {r.host: r.verdict for r in got if not r.rule}
    assert open_hosts == {h: "block" if want[h][1] - want[h][0] > url_filter.ONE // 2 else "allow" for h in open_hosts} and set(open_hosts.values()) == {"allow", "block"}
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(f"select {', '.join(got[0].__fields__)} from ({oracles.URLS})").fetchall()))
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pseudonyms(spark):
    text = "Mail ann.lee7@x.example.com or +1 (212) 555-7713, 10.20.30.40, card 4111 1111 1111 1111 or 4111-1111-1111-1111, born 1980-02-29 or 29/02/1980, ssn 123-45-6789, GB82 WEST 1234 5698 7654 32. v1.2.3.4.5 12:30"
    out = pii.pseudonymize(frame(spark, [(1, text), (2, text), (3, None), (4, ""), (5, "nothing 12")]), "key").orderBy("doc_id").collect()
    assert out[0].text == out[1].text and out[2].text is None and out[3].text == "" and out[4].text == "nothing 12"
    kinds, values = [x.kind for x in out[0].pii], [x.value for x in out[0].pii]
    assert kinds == ["email", "phone", "ip", "card", "card", "date", "date", "ssn", "iban"]
    for secret in ("ann.lee7", "555-7713", "10.20.30.40", "4111 1111 1111 1111", "1980-02-29", "123-45-6789", "1234 5698"):
        assert secret not in out[0].text
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(values[3]) == digits(values[4]) and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits(values[3])))) % 10 == 0
    assert values[5] == "-".join(reversed(values[6].split("/"))) and all(int(x) < 256 for x in values[2].split("."))
    compact = values[8].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    assert out[0].text.endswith("v1.2.3.4.5 12:30")
    assert pii.pseudonymize(frame(spark, []), "key").collect() == []


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_of_random_texts(spark):
    """Every planted value is found by kind, replaced in its own format, and equal values alike; the rest stays."""
    import datetime
    import re

    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    people, cards, days, wrong = [f"ann.{k}" for k in range(4)], [], [datetime.date(1960, 1, 1) + datetime.timedelta(rng.randrange(20000)) for _ in range(6)], []
    while len(cards) < 5 or len(wrong) < 3:
        c = "4" + digits(15)
        if len(to := cards if luhn(c) else wrong) < 5:
            to.append(c)

    def planted():
        kind = rng.choice(("card", "wrong", "date", "email", "phone", "ssn"))
        if kind in ("card", "wrong"):
            c = rng.choice(cards if kind == "card" else wrong)
            return kind, c, rng.choice(["", " ", "-"]).join(c[k : k + 4] for k in range(0, 16, 4))
        if kind == "date":
            d = rng.choice(days)
            forms = [f"{d:%Y-%m-%d}", f"{d:%d/%m/%Y}", f"{d:%d.%m.%Y}", f"{d.day}/{d.month}/{d.year}"] + [f"{d:%m/%d/%Y}", f"{d.month}/{d.day}/{d.year}"] * (d.day > 12)
            return kind, d, rng.choice(forms)
        if kind == "email":
            who = rng.choice(people)
            return kind, who + "@mail.example", rng.choice([who, who.title()]) + "@mail.example"
        value = digits(10)
        return kind, value, f"({value[:3]}) {value[3:6]}-{value[6:]}" if kind == "phone" else f"{value[:3]}-{value[3:5]}-{value[5:9]}"

    filler = ["and", "version 2.4", "no 17", "at 12:30", "exp 12/27", "(x)", "é"]
    texts, plan = [], []
    for _ in range(150):
        parts = [planted() for _ in range(rng.randrange(1, 5))]
        words = [rng.choice(filler) for _ in range(len(parts) + 1)]
        plan.append((parts, words))
        texts.append(" ".join(x for w, p in zip(words, [*parts, None]) for x in ([w, p[2]] if p else [w])))
    rows = pii.pseudonymize(frame(spark, list(enumerate(texts))), "key").collect()
    new = {}
    for r in rows:
        parts, words = plan[r.doc_id]
        assert [x.kind for x in r.pii] == ["number" if p[0] == "wrong" else p[0] for p in parts], texts[r.doc_id]
        assert r.text == " ".join(x for w, v in zip(words, [*r.pii, None]) for x in ([w, v.value] if v else [w]))
        for (kind, value, old), x in zip(parts, r.pii):
            if kind != "date":
                assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", old.lower())) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", x.value.lower()))
            assert kind != "card" or luhn(re.sub("[^0-9]", "", x.value))
            if kind == "date":
                p = [int(y) for y in re.split("[/.-]", x.value)]
                o = [int(y) for y in re.split("[/.-]", old)]
                x = datetime.date(*(p if o[0] > 31 else (p[2], p[0], p[1]) if o[1] > 12 else (p[2], p[1], p[0])))
            else:
                x = x.value if kind == "email" else re.sub("[^0-9]", "", x.value)
            assert new.setdefault((kind, value), x) == x and x != value
    assert len({v for (k, _), v in new.items() if k == "date"}) == len({k for k in new if k[0] == "date"})


def test_pseudonyms_leave_no_card_before_other_digits(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/27", f"{card} 123", f"{card} 5500 0000 0000 0004", "4111111111111111 12/27", f"x{card}", "1 2 3 4 5 6 7 8 9 10 11 12 13", "9" * 30, "31/31/2000 1815-06-18 1.2.3.2000", card + " ok " * 30_000]
    got = [r.text for r in pii.pseudonymize(frame(spark, list(enumerate(texts))), "key").orderBy("doc_id").collect()]
    assert not any(card in t or "4111111111111111" in t or "5500 0000" in t for t in got) and got[0].endswith("/27") and got[8].endswith(" ok ")
    assert got[0][:19] == got[1][:19] == got[8][:19] and got[5] == texts[5] and got[6] != texts[6] and got[7] == texts[7]


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v")).withColumn("p", pii.feistel(F.col("v"), "k")).withColumn("b", pii.feistel(F.col("p"), "k", inverse=True))
    rows = df.collect()
    assert sorted(r.p for r in rows) == [f"{k:03d}" for k in range(1000)]
    assert all(r.v == r.b for r in rows) and sum(r.v == r.p for r in rows) < 20


def plain_words(text):
    """Words without punctuation at their ends, by a plain scan."""
    import re

    bare = (re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", w) for w in brute.words(text))
    return [w for w in bare if w]


def plain_distance(item, text):
    """Least word edit distance between the item and any part of the text, by the full table."""
    row = list(range(len(item) + 1))
    least = row[-1]
    for x in text:
        new = [0]
        for i, y in enumerate(item):
            new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (x != y)))
        row = new
        least = min(least, row[-1])
    return least


def edited(rng, words, k):
    out = list(words)
    for place in sorted(rng.sample(range(len(out)), k), reverse=True):
        out[place : place + 1] = rng.choice((["edited"], [], ["edited", out[place]]))
    return out


def test_decontamination_reaches_its_recall_at_every_length_and_threshold():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(900)]
    for n in range(1, 61):
        for k in sorted({0, n // 10, n // 5}):
            items = [(i, " ".join(rng.sample(vocab, n))) for i in range(30)]
            index = decontam.ItemIndex(items, 0.2, decontam.walks_by_length(items, 0.2, 0.99))
            around = lambda: " ".join(rng.choices(vocab, k=25))
            texts = [f"{around()}, {' '.join(edited(rng, t.split(), k))}. {around()}" for _, t in items]
            found = {(d, i): dist for d, i, dist, *_ in index.search(texts)}
            assert sum((i, i) in found for i in range(30)) >= 27, (n, k)
            for (d, i), dist in list(found.items())[:4]:
                assert dist == plain_distance(plain_words(items[i][1]), plain_words(texts[d])) <= 0.2 * n


def test_decontamination_reports_each_pair_once_and_takes_odd_rows(spark):
    item, long = "who wrote the first book", "filler words here " * 40_000
    rows = [(5, f"a {item} b"), (5, f"c {item}"), (6, "Who wrote the first book? " + long), (7, None), (8, ""), (None, item), (9, "who wrote a first book"), (10, "who wrote")]
    docs = spark.createDataFrame([(d, t, 0, 1, 2, 3) for d, t in rows], "doc_id long, text string, item_id int, distance int, n_words int, first_word int")
    items = spark.createDataFrame([(1, item, "x"), (1, item + " ever", "x"), (1, item, "x"), (2, item, "x"), (3, "", "x"), (4, None, "x"), (None, item, "x")], "item_id long, text string, doc_id string")
    got = decontam.find_items(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(d, i, n) for d, n in ((5, 0), (6, 0), (9, 1)) for i in (1, 2)]
    assert sorted((r.doc_id, r.n_items) for r in decontam.contaminated(docs, items).collect()) == [(5, 2), (6, 2), (9, 2)]
    assert decontam.find_items(docs, items.limit(0)).collect() == [] and decontam.find_items(docs.limit(0), items).collect() == []


def test_decontamination_in_blocks(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(12))) for k in range(30)]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    got = decontam.find_items(docs, docs.withColumnRenamed("doc_id", "item_id"), block_items=8).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(30)]


def test_functions_sent_to_executors_need_no_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    sent = [decontam.ItemIndex, decontam.words_of, line_dedup._align, ngram_join.join_cell, suffix_dedup._cut, sentencepiece_sa.encode]
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(sent))
    subprocess.run([sys.executable, "-c", f"import pickle; assert len(pickle.load(open('{tmp_path}/sent', 'rb'))) == {len(sent)}"], cwd=tmp_path, check=True)


def test_line_dedup_of_a_passage_that_all_documents_hold(spark):
    notice = "this notice stands in all\nof the documents we have\nend"
    for n in (2, 3, 5, 12):
        docs = [(k, f"own line of document {k}\n{notice}") for k in range(n)]
        got = {r.doc_id: r.text for r in line_dedup.drop_common_blocks(frame(spark, docs)).collect()}
        assert got == {0: docs[0][1]} | {k: f"own line of document {k}" for k in range(1, n)}


def test_linked_sets_share_a_part_name():
    rng = np.random.default_rng(6)
    for num, small, large, both, pairs in ((90, 64, 71, 64, 30000), (90, 67, 70, 65, 30000), (80, 64, 79, 64, 30000), (80, 9, 11, 9, 10000), (80, 900, 1100, 889, 500)):
        firsts = ngram_join._class_ends(1 << 12, num, 100)
        assert 100 * both >= num * (small + large - both)
        for _ in range(pairs):
            grams = rng.integers(0, 2**64, small + large - both, dtype=np.uint64)
            a, b = np.sort(grams[:small]), np.sort(grams[small - both :])
            assert set(ngram_join.part_names(a, num, 100, firsts).tolist()) & set(ngram_join.part_names(b, num, 100, firsts).tolist())
