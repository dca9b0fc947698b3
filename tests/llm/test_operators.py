"""Every operator against brute force on small tables, with nulls, empty and long texts, repeated rows and clashing columns."""

import base64
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import capjoin, decontam, jaccard, mixing, pii, queries, secrets, sharding, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, source string, n_hit long, score double, shard int, __salt string, mix_copy int"


def docs(spark, *texts):
    """Texts as documents, with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, f"s{i % 2}", -1, -1.0, -1, "x", -1) for i, t in enumerate(texts)], DOCS)


def repeated(spark, rows):
    return spark.createDataFrame([(i, t, "s", -1, -1.0, -1, "x", -1) for i, t in rows], DOCS)


# ---- op1

def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "a" * 50), (2, "v\r\nx", None), (3, None, ""), (4, "u", "é" * 4000), (5, "u", "é" * 4000), (5, "u", "é" * 4000), (None, "u", "zz"), (8, "u", "a" * 50), (7, "q", "".join(map(str, range(3000)))), (7, "q", "".join(map(str, range(3000))))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.archived(df, str(tmp_path / "w"), chunk=1000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    groups, want = defaultdict(list), Counter()
    for p, _, h in rows:
        groups[h or ""].append(p)
    for p, _, h in rows:
        b, ids = (h or "").encode(), [x for x in groups[h or ""] if x is not None]
        revisit = len(groups[h or ""]) > 1 and bool(ids) and p != max(ids)
        want[(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", max(ids) if revisit else None)] += 1
    assert got == want
    import gzip

    archives = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*"))
    assert archives.count(b"WARC-Type: continuation") == 2 * 7 + 2 * 10
    assert archives.count(b"WARC-Type: revisit") == sum(n for k, n in want.items() if k[3] == "revisit")


def test_warc_refuses_changed_bytes(spark):
    with pytest.raises(ValueError, match="cut off|not a WARC|incorrect|Error"):
        try:
            warc.parse(warc.unzip(warc.member(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[:-3]))
        except zlib.error as e:
            raise ValueError("Error") from e


def test_warc_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(empty, str(tmp_path / "w")).count() == 0


# ---- op2 and op4

def by_pattern(text):
    """The base rules as plain expressions, for comparison."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_pii_base_spans_are_the_rules(spark):
    r = np.random.default_rng(3)
    alphabet = list("ab.@-_+%0123456789 ()é.1@")
    texts = ["".join(r.choice(alphabet, 60)) for _ in range(400)] + ["x@a@b.c a.b@c-d.e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0000000000255.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (555) 123-4567 +12", "é" * 50 + "+49 30 1234567"]
    for t in texts:
        assert pii.base_spans(t) == by_pattern(t), t


def test_pii_adds_and_keeps(spark):
    rows = {r["doc_id"]: r for r in pii.digest(pii.scan(docs(spark, None, "", "mail a@b.example now", "phone (555) 123-4567, ask", "born 1999-10-12 sum 123.456"))).collect()}
    assert rows[0]["spans"] == rows[1]["spans"] == "" and rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[2]["spans"] == "email:5:16" and rows[2]["n_email"] == 1 and rows[2]["base_sha256"] == hashlib.sha256(b"email:5:16").hexdigest()
    assert rows[3]["spans"] == "phone:6:20" and rows[3]["n_phone"] == 0
    assert rows[4]["spans"] == ""


@pytest.mark.parametrize("kind, s", [
    ("phone", "555 123 4567"), ("phone", "1 555 1234567"), ("phone", "030/1234567"), ("phone", "5551234567"), ("phone", "(555) 123-4567"), ("card", "3782 822463 10005"), ("card", "3714-496353-98431"),
    ("email", "first.last-name (at) sub.example (dot) co (dot) uk"), ("email", "jane.doe (AT) example [DOT] org"), ("email", "some.one-with-a-long-name (at) a-rather-long.host-name.example (dot) co (dot) uk"),
])
def test_pii_boundaries_outside_the_forms(kind, s):
    cue = {"phone": "phone", "card": "visa", "email": "contact"}[kind]
    assert pii.finder(pii.fitted())(f"my {cue} {s}, and more")[1] == [(kind, 4 + len(cue), 4 + len(cue) + len(s))]


@pytest.mark.parametrize("s", ["5551234567", "1999-10-12", "1999-10-12 10", "3782 822463 10006", "978-3-16-148410-0", "1 234 567 890", "123-45-6789", "20240131123000", "3.141592653"])
def test_pii_leaves_other_numbers(s):
    assert pii.finder(pii.fitted())(f"the order {s}, and more")[1] == []


def test_pii_time_is_linear():
    import time

    weights, began = pii.fitted(), time.time()
    find = pii.finder(weights)
    for t in ("1" * 200_000, "1.2." * 50_000, "a" * 200_000 + "@", "+1" + "(" * 200_000, "a@" * 100_000):
        find(t)
    assert time.time() - began < 60


@pytest.mark.parametrize("s", ["iban DE89 3704 0044 0532 0130 00 is", "order 555-123-4567 parts", "iban GB82 WEST 1234 5698 7654 32 is", "version 1.2.3.4567 of"])
def test_pii_leaves_numbers_of_other_kinds(s):
    assert pii.finder(pii.fitted())(s) == ([], [])


def test_pii_gradient_by_differences():
    r, (text, gold) = np.random.default_rng(4), next(iter(pii._examples(1, seed=11)))
    edges, pairs = pii.segments(text, 0, len(text), 32, 96)
    x = np.array([pii.vector(k) for k in pii.keys_of(text, edges, pairs)])
    w, place = r.normal(size=x.shape[1:]) * 0.3, {e: i for i, e in enumerate(edges)}
    truth = np.zeros(x.shape[:2])
    for a, b, kind in gold:
        truth[pairs.index((place[a], place[b])), pii.RANK[kind]] = 1
    score = lambda w: np.einsum("nkf,kf->nk", x, w)
    value = lambda w: (truth * score(w)).sum() - pii.expected(score(w), pairs, len(edges) - 1)[0]
    gradient = np.einsum("nk,nkf->kf", truth - pii.expected(score(w), pairs, len(edges) - 1)[1], x)
    for _ in range(40):
        step = np.zeros_like(w)
        step[r.integers(0, w.shape[0]), r.integers(0, w.shape[1])] = 1e-5
        assert (value(w + step) - value(w - step)) / 2e-5 == pytest.approx((gradient * step).sum() / 1e-5, abs=1e-4)


def test_pii_decodes_whole_texts_like_all_segmentations():
    find = pii.finder(pii.fitted())
    for text, _ in pii._examples(60, seed=5):
        base, added = find(text)
        taken = set(p for _, a, b in base for p in range(a, b))
        want = []
        for m in [*pii.MASKED.finditer(text), *pii.REGION.finditer(text)]:
            limits = (pii.MASKED_SEGMENT, pii.MASKED_CHARS) if m.re is pii.MASKED else (pii.MAX_SEGMENT, pii.MAX_CHARS)
            edges, pairs = pii.segments(text, *m.span(), *limits)
            scores = {p: (pii.vector(k) * pii.fitted()).sum(axis=1) for p, k in zip(pairs, pii.keys_of(text, edges, pairs))}
            best = [(0.0, [])]
            for j in range(1, len(edges)):
                options = [(best[i][0] + scores[i, j].max(), [*best[i][1], (pii.KINDS[int(scores[i, j].argmax())], edges[i], edges[j])]) for i in range(j) if (i, j) in scores]
                best.append(max([best[j - 1], *options], key=lambda o: o[0]))
            for kind, a, b in best[-1][1]:
                if not taken & set(range(a, b)):
                    want.append((kind, a, b))
                    taken |= set(range(a, b))
        assert added == want, text


def test_pii_of_many_entities_grows_in_proportion():
    import time

    find, times = pii.finder(pii.fitted()), []
    unit = "call (555) 123-4567 or mail jane.doe (at) example (dot) org, host 10.1.2.3, "
    find(unit * 200)
    for n in (1500, 3000):
        began = time.process_time()
        assert len(find(unit * n)[1]) == 2 * n
        times.append(time.process_time() - began)
    assert times[1] < 2.6 * times[0] + 0.1


@pytest.mark.parametrize("scan", [lambda d: pii.digest(pii.scan(d)), lambda d: secrets.digest(secrets.scan(d))])
def test_scans_of_nothing_and_of_repeated_rows(spark, scan):
    d = repeated(spark, [(1, "a@b.cd token=abcdef"), (1, "a@b.cd token=abcdef"), (None, None)])
    rows = [tuple(r) for r in scan(d).collect()]
    assert len(rows) == 3 and len(set(rows)) == 2 and scan(d.limit(0)).count() == 0


def test_segmentation_is_the_best_of_all():
    r = np.random.default_rng(0)
    for _ in range(50):
        pairs = [(0, 2), (1, 3), (2, 4), (0, 4), (3, 5), (1, 5)]
        scores = r.normal(size=(len(pairs), 4))

        def top(at):
            if at == 5:
                return 0.0
            return max([top(at + 1), *(scores[k].max() + top(j) for k, (i, j) in enumerate(pairs) if i == at)])

        chosen = pii.best(scores, pairs, 5)
        assert sum(scores[pairs.index((i, j)), k] for i, j, k in chosen) == pytest.approx(top(0))


def test_secrets(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
    find, r = secrets.finder(), np.random.default_rng(5)
    pieces = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "=", ":", " ", "'", '"', "abc", "123456", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "İ", "K", "\n", "tokentoken=abcdefg"]
    for _ in range(400):
        t = "".join(r.choice(pieces, 14))
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6] + [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [s for s in find(t) if s[0] in ("assign", "access", "hex")] == sorted(want, key=lambda s: (s[1], secrets.RANK[s[0]])), t
    body = "A" * 30
    value, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        check = secrets.BASE62[d] + check
    assert [s[0] for s in find(f"x ghp_{body}{check} y")] == ["token"] and find(f"x ghp_{body}000000 y") == []
    long = "x " * 600_000 + "password = abcdef " + "y " * 600_000
    assert find(long) == [("assign", 1_200_000, 1_200_017)]
    rows = {x["doc_id"]: x for x in secrets.digest(secrets.scan(docs(spark, None, "", "é token: abcdef1"))).collect()}
    assert rows[0]["spans"] == rows[1]["spans"] == "" and rows[2]["spans"] == "assign:2:16" and rows[2]["n_assign"] == 1


def test_secrets_with_embedded_checksums():
    find, raw = secrets.finder(), bytes.fromhex("0488ade4") + bytes(range(74))
    value = int.from_bytes(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4], "big")
    text = ""
    while value:
        value, d = divmod(value, 58)
        text = secrets.BASE58[d] + text
    assert text[:4] == "xprv" and len(text) == 111
    assert [x[0] for x in find(f"key {text}.")] == ["xprv"] and find(f"key {text[:-1]}{'1' if text[-1] != '1' else '2'}.") == []
    data = "".join(secrets.BECH32[i % 32] for i in range(52))
    rest = secrets.bech32_sum("age-secret-key-", data + "Q" * 6) ^ 1
    full = "AGE-SECRET-KEY-1" + data + "".join(secrets.BECH32[rest >> 5 * (5 - i) & 31] for i in range(6))
    assert [x[0] for x in find(f"id {full} x")] == ["age"] and find(f"id {full[:-1]}{'Q' if full[-1] != 'Q' else 'P'} x") == []
    assert secrets.bech32_sum("a", "2UEL5L".replace("2UEL5L", "2UEL5L")) == 1


# ---- op3

def check_shards(rows, texts, n):
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    sizes = [len(per.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


@pytest.mark.parametrize("texts", [
    [f"t{i // 3}" for i in range(200)], ["same"] * 100 + [None, "", "", "x"], ["a"] * 30 + ["b"] * 30 + [f"u{i}" for i in range(40)], ["one"], [],
])
def test_sharding(spark, texts):
    rows = sharding.sharded(docs(spark, *texts), 7).collect()
    check_shards(rows, texts, 7)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["grown_shard"] is None


def test_sharding_keeps_groups_together(spark):
    texts = [f"t{i // 3}" for i in range(210)] + [f"single {i}" for i in range(300)]
    rows = sharding.sharded(docs(spark, *texts), 7).collect()
    check_shards(rows, texts, 7)
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(w) == 1 for w in where.values()) > 0.95 * len(where)


def propagated_plainly(counts, quota, rounds, tie, share):
    """The rounds of propagation as loops over groups."""
    k, groups = len(quota), {g: list(c) for g, c in counts.items()}
    for turn in range(rounds):
        room = np.array([quota[s] - sum(c[s] for c in groups.values()) for s in range(k)])
        near = [s for s in range(k) if room[s] > 0 and 4 * room[s] >= max(room)] if turn % 2 else list(range(k))
        if not near:
            continue
        target = {g: max(near, key=lambda s: (c[s], tie[g][s])) for g, c in groups.items()}
        asked = np.zeros((k, k, sharding.SLICES))
        for g, c in groups.items():
            for s in range(k):
                if s != target[g] and 0 < c[s] <= c[target[g]]:
                    asked[s, target[g], share[g][0]] += c[s]
        if not asked.any() and not turn % 2:
            break
        granted, before = sharding.feasible(asked.sum(axis=2), room), np.cumsum(asked, axis=2) - asked
        part = np.clip(np.divide(granted[:, :, None] - before, asked, out=np.zeros_like(asked), where=asked > 0), 0, 1)
        for g, c in groups.items():
            t = target[g]
            gone = [int(np.floor(c[s] * part[s, t, share[g][0]] + share[g][1][turn][s] / 1001)) if s != t and c[s] <= c[t] else 0 for s in range(k)]
            groups[g] = [c[s] - gone[s] + (sum(gone) if s == t else 0) for s in range(k)]
    return groups


def test_propagation_is_the_plain_loop(spark):
    from quillframe.plans.tables import written

    r, k, rounds = np.random.default_rng(3), 5, 6
    counts = {f"g{i}": [int(x) for x in r.integers(0, 4, k) * (r.random(k) < 0.6)] for i in range(60)} | {"big": [40, 30, 20, 10, 5]}
    total = sum(map(sum, counts.values())) + 60
    quota = [total // k + (s < total % k) for s in range(k)]
    names = spark.createDataFrame([(g,) for g in counts], "g string")
    hashes = names.select("g", F.array(*[F.xxhash64("g", F.lit(s)) for s in range(k)]), F.pmod(F.xxhash64("g"), F.lit(sharding.SLICES)), F.array(*[F.array(*[F.pmod(F.xxhash64("g", F.lit(s), F.lit(t)), F.lit(1000)) for s in range(k)]) for t in range(rounds)])).collect()
    tie, share = {h[0]: h[1] for h in hashes}, {h[0]: (h[2], h[3]) for h in hashes}
    cut = lambda groups: sum(sum(c) ** 2 - sum(x * x for x in c) for c in groups.values()) // 2
    last = cut(counts)
    for n in range(rounds + 1):
        want = propagated_plainly(counts, quota, n, tie, share)
        table = written(spark.createDataFrame(list(counts.items()), "g string, counts array<bigint>"), "test-groups")
        assert {row["g"]: row["counts"] for row in sharding.propagated(table, quota, n).collect()} == want
        assert cut(want) <= last
        last = cut(want)
    small = lambda groups: {g: c for g, c in groups.items() if g != "big"}
    assert last < cut(counts) and cut(small(want)) < cut(small(counts)) / 4


def test_moves_respect_room():
    r = np.random.default_rng(2)
    for _ in range(20):
        asked, room = r.integers(0, 50, (6, 6)).astype(float), r.integers(0, 30, 6)
        moves = sharding.feasible(asked, room)
        assert (moves <= asked + 1e-9).all() and (moves.sum(axis=0) <= room + moves.sum(axis=1) + 1e-3).all()


# ---- op5

def brute_hits(text, items, width=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, names = norm(text), set(), set()
    for name, t in items:
        own = norm(t)
        k = min(width, len(own))
        for i in range(len(own) - k + 1) if k else ():
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("most", [decontam.MAX_WINDOWS, 5])
def test_decontamination(spark, most):
    r = np.random.default_rng(2)
    vocabulary = ["The", "of", "É", "x1", "and", "zu"]
    items = [(i, " ".join(r.choice(vocabulary, n))) for i, n in enumerate((14, 10, 4, 2, 30))] + [(9, ""), (10, None), (2, "x1, x1 x1")]
    texts = [" ".join(r.choice(vocabulary, 40)) + "! " + items[i % 5][1].upper().replace("É", "É") + " tail" for i in range(20)] + [None, "", "Q " * 30]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for row in decontam.digest(decontam.scan(docs(spark, *texts), bench, most=most)).collect():
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"]) == brute_hits(texts[row["doc_id"]], items), texts[row["doc_id"]]
        assert row["contaminated"] == (row["n_hit"] > 0)
    kept = decontam.clean(docs(spark, *texts), bench, most=most)
    assert kept.columns == docs(spark).columns and {x["doc_id"] for x in kept.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    assert decontam.without_hits(b"a, b c. d", [(1, 3)]) == b"a, . d"
    assert decontam.scan(docs(spark, "a b"), bench.limit(0)).first()["n_words"] == 2 and decontam.scan(docs(spark).limit(0), bench).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    r = np.random.default_rng(8)
    text = " ".join(r.choice(["alpha", "beta", "gamma", "delta"], 3000)).encode()
    windows = decontam.Windows([("i", text[2000:2200])], 10)
    whole, sets = decontam.matcher(windows)(text), jaccard.Shingler()(text)
    monkeypatch.setattr(decontam, "PIECE", 100)
    monkeypatch.setattr(jaccard, "PIECE", 100)
    assert decontam.matcher(windows)(text) == whole and whole[1] and (jaccard.Shingler()(text) == sets).all()


# ---- op6

def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/1?x", "https://a.example.org/en/12", "http://x.org", "http://x.org/", "http://q.com/fr/1#y", "http://q.com/de/", "http://notorg/x", "x://host?a=/b", "http://a.b/c://d/e"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in urlfilter.judged(pages).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        m = re.match(r"([^/?#]*)([^?#]*)", rest) if rest is not None else None
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for a, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (rows[i]["host"], rows[i]["path"]) == (host, path), u
        assert rows[i]["rule"] == (max(fits)[1] if fits else None), u
        assert rows[i]["verdict"] == (max(fits)[2] if fits else rows[i]["verdict"]) and rows[i]["verdict"] in ("allow", "block")
    assert urlfilter.judged(pages.limit(0)).count() == 0


def test_url_model(spark):
    pages = spark.createDataFrame([(i, f"http://a{i}.org/good/garden{i}") for i in range(40)] + [(100 + i, f"http://b{i}.com/de/casino{i}") for i in range(40)] + [(200, "http://z.net/good/garden"), (201, "http://z.net/de/casino")], "page_id long, url string")
    rows = {r["page_id"]: r for r in urlfilter.judged(pages).collect()}
    assert rows[200]["verdict"] == "allow" and rows[201]["verdict"] == "block" and rows[200]["score"] > rows[201]["score"]


def test_url_threshold_comes_from_urls_that_train_no_model(spark):
    scores = spark.createDataFrame([(f"http://u{i}.org/", 1, ("allow", "block")[i % 2], float(-(i % 2)) + 0.01 * (i % 7)) for i in range(60)] + [("http://open/", 1, None, 9.0)], "url string, n long, action string, score double")
    rows = [(r["action"], r["score"]) for r in scores.filter(urlfilter.held(F.col("url"))).collect()]
    chosen = [x for x in rows if x[0]]
    assert 4 <= len(chosen) < 30 and max(v for a, v in chosen if a == "block") < urlfilter.threshold(scores) <= min(v for a, v in chosen if a == "allow") + 1e-9
    one = scores.filter((F.col("action") == "allow") | ~urlfilter.held(F.col("url")))
    assert -0.94 < urlfilter.threshold(one) < 0.01


def test_urls_that_repeat_or_tie_are_judged_alike(spark):
    urls = ["http://a.org/x", "http://a.org/x", "http://q.net/x", "http://q.net/x", "http://b.com/de/x", None, None]
    rows = urlfilter.judged(spark.createDataFrame([(i, u, 0, 0) for i, u in enumerate(urls)], "page_id long, url string, n long, gram int")).collect()
    by = defaultdict(set)
    for r in rows:
        by[urls[r["page_id"]]].add((r["verdict"], r["score"]))
    assert len(rows) == 7 and all(len(v) == 1 for v in by.values())


# ---- op7

def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16))
    near = base[:20] + r.normal(size=(20, 16)) * 0.12
    x = [list(map(float, v)) for v in [*base, *near, *base[:5], *(base[3] + r.normal(size=(30, 16)) * 0.05)]]
    x += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    rows = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, node int")
    got = {g["vec_id"]: g for g in capjoin.linked(rows).collect()}
    f = [None if not v or not any(v) or any(c != c for c in v) else np.array(v, dtype=np.float32).astype(float) for v in x]
    links = {i: {j for j, b in enumerate(f) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9} for i, a in enumerate(f)}
    found = sum(g["n_links"] for g in got.values())
    assert found >= 0.99 * sum(map(len, links.values())) and all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (len(x) - 6, len(x) - 5, len(x) - 4, len(x) - 3))
    assert got[len(x) - 1]["component_id"] == len(x) - 2 and not got[len(x) - 1]["kept"]


def test_split_buckets_count_once(spark, monkeypatch):
    monkeypatch.setattr(capjoin, "SPLIT", 8)
    r = np.random.default_rng(6)
    v = r.normal(size=16) + r.normal(size=(50, 16)) * 0.03
    rows = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = capjoin.linked(rows).collect()
    assert {g["n_links"] for g in got} == {49} and {g["component_id"] for g in got} == {0}


def test_short_vectors_meet(spark):
    r, rows, want = np.random.default_rng(12), [], {}
    for dim in (1, 2, 3, 4, 6, 8):
        x = r.normal(size=(1200, dim)).astype(np.float32)
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        want |= {len(rows) + i: int(n) - 1 for i, n in enumerate((unit @ unit.T >= 0.9 - 1e-12).sum(axis=1))}
        rows += [(len(rows) + i, list(map(float, v))) for i, v in enumerate(x)]
    got = {g["vec_id"]: g["n_links"] for g in capjoin.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    for d in range(6):
        ids = range(d * 1200, d * 1200 + 1200)
        assert all(got[i] <= want[i] for i in ids) and sum(got[i] for i in ids) >= 0.995 * sum(want[i] for i in ids), d


def test_lone_pairs_of_short_vectors(spark):
    rows, side = [], np.sqrt(1 - 0.901**2)
    for dim in (2, 3, 4, 5, 6):
        for i in range(dim):
            for sign in (1.0, -1.0):
                axis, next_ = sign * np.eye(dim)[i], sign * np.eye(dim)[(i + 1) % dim] * (1 if i + 1 < dim or dim > 2 else -1)
                rows += [(len(rows), list(map(float, axis))), (len(rows) + 1, list(map(float, 0.901 * axis + side * next_)))]
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in capjoin.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (1, i - i % 2) for i in range(len(rows))}


@pytest.mark.parametrize("dim, n, threshold", [(2, 1000, 0.9), (3, 1000, 0.9), (4, 100_000, 0.9), (8, 20_000, 0.9), (64, 500, 0.9), (64, 50_000, 0.9), (64, 10**9, 0.9), (64, 20_000, 0.3)])
def test_lists_reach_the_target(dim, n, threshold):
    size, height = capjoin.planned(dim, n, threshold)
    code, (x, y) = capjoin.Codes(dim, size), capjoin.pairs_at(dim, threshold, 1000, 99)
    (p, f), (q, g) = code.lists(x, height), code.lists(y, height)
    lists = [[set(names[rows == i].tolist()) for i in range(1000)] for rows, names in ((p, f), (q, g))]
    assert sum(bool(a & b) for a, b in zip(*lists)) >= 985 and (size or dim < 3 or threshold < 0.5), (size, height)


def test_planning_for_short_vectors_takes_little_memory():
    tracemalloc.start()
    assert capjoin.calibrated.__wrapped__(4, 4096, 0.9) is None
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_list_decoding_finds_all_directions(monkeypatch):
    monkeypatch.setattr(capjoin, "SUMS", 50)
    code, r = capjoin.Codes(10, 6), np.random.default_rng(1)
    x = r.normal(size=(40, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = list(zip(*(v.tolist() for v in code.above(x, 0.4)[:2])))
    want = []
    for i, v in enumerate(x):
        for c, (turn, (first, second)) in enumerate(zip(code.turns, code.words)):
            for k, a in enumerate(first):
                for m, b in enumerate(second):
                    direction = turn @ np.concatenate([a, b])
                    assert np.linalg.norm(direction) == pytest.approx(1)
                    if v @ direction >= 0.4:
                        want.append((i, c * 36 + k * 6 + m))
    assert got == sorted(want)
    assert code.above(x, 0.4, len(want) - 1) is None and len(code.above(x, 0.4, len(want))[0]) == len(want)
    row, _ = code.lists(x, 0.9)
    assert np.bincount(row, minlength=40).min() >= capjoin.LEAST


def test_sketches_of_linked_pairs_are_close():
    for dim in (2, 3, 64):
        x, y = capjoin.pairs_at(dim, 0.9, 20_000, 5)
        away = np.bitwise_count(capjoin.sketches(x) ^ capjoin.sketches(y)).sum(axis=1)
        assert away.max() <= capjoin.most_bits(0.9) < 0.375 * capjoin.SKETCH


def test_recall_of_lone_pairs(spark):
    x, y = capjoin.pairs_at(64, 0.9005, 1500, 7)
    rows = [(2 * i + k, list(map(float, v))) for i, pair in enumerate(zip(x, y)) for k, v in enumerate(pair)]
    got = capjoin.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).agg(F.sum("n_links")).first()[0]
    assert 3000 * 0.985 <= got <= 3000


def test_vectors_without_ids_and_without_rows(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (4, [2.0, 0.1]), (None, [0.0, 1.0]), (4, [2.0, 0.1])], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in capjoin.linked(rows).collect()))
    assert got == [(0, 0, 0, True), (0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]
    assert capjoin.linked(rows.limit(0)).count() == 0


# ---- op8

def test_toxicity(spark):
    r = np.random.default_rng(8)
    plain = ["garden", "river", "stone", "cloud", "table", "paper"]
    texts = [" ".join(r.choice(plain, 30)) + (" rotten " + " ".join(r.choice(plain, 5)) if i % 4 == 0 else "") for i in range(600)]
    d = docs(spark, *texts, None, "")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(600)] + [(601, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels)
    s = {x["doc_id"]: x["score"] for x in toxicity.scored(d, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s[i] >= 0.7) == (i % 4 == 0) for i in held) > 0.95 * len(held)
    assert s[600] == s[601] and 0 <= s[600] <= 1 and len(model.index) < 2000
    kept = toxicity.scored(d, model, keep_below=0.7)
    assert kept.columns == d.columns and {x["doc_id"] for x in kept.collect()} == {i for i, v in s.items() if v < 0.7}
    none = toxicity.fit(d, labels.limit(0))
    assert {x["score"] for x in toxicity.scored(d.limit(3), none).collect()} == {0.5}


def test_ftrl_weights_are_the_plain_loop():
    r = np.random.default_rng(2)
    rows = [(np.unique(r.integers(0, 40, 12)), int(r.random() < 0.4)) for _ in range(300)]
    model, z, n, bias, bias_n = toxicity.ftrl(rows), defaultdict(float), defaultdict(float), None, 0.0
    positive = sum(y for _, y in rows)
    prior = (positive + 0.5) / (len(rows) + 1)
    bias = np.log(prior / (1 - prior))

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for f, y in rows:
            p = 1 / (1 + np.exp(-(bias + sum(weight(int(i)) for i in f))))
            g = p - y
            for i in map(int, f):
                w = weight(i)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w
                n[i] += g * g
            bias_n += g * g
            bias -= toxicity.ALPHA / (toxicity.BETA + bias_n**0.5) * g
    want = {i: weight(i) for i in list(z) if weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(want, rel=1e-4) and model.bias == pytest.approx(bias) and 0 < len(want) < 40


def test_calibration_is_the_minimum():
    r = np.random.default_rng(6)
    rows = [(np.array([i % 5]), int(r.random() < (0.1, 0.3, 0.5, 0.7, 0.9)[i % 5])) for i in range(400)]
    raw = toxicity.Model(np.arange(5), np.array([-1.0, -0.4, 0.1, 0.5, 1.2], dtype=np.float32), 0.2)
    fitted = toxicity.calibrated(raw, rows)
    slope, shift = float(fitted.weight[4] / raw.weight[4]), fitted.bias - raw.bias * float(fitted.weight[4] / raw.weight[4])
    y = np.array([y for _, y in rows])
    score = np.array([raw.bias + raw.weight[f[0]] for f, _ in rows])
    weights, goal = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y), np.where(y == 1, 0.995, 0.005)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * score + b)))
        return -(weights * (goal * np.log(p) + (1 - goal) * np.log(1 - p))).sum() + 0.05 * (a - 1) ** 2 + 0.005 * b * b

    assert all(loss(slope, shift) <= loss(slope + a, shift + b) + 1e-9 for a, b in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02)))


def test_toxicity_of_nothing_ties_and_repeated_rows(spark):
    d = repeated(spark, [(1, "same words"), (1, "same words"), (2, "same words"), (None, None), (3, "")])
    model = toxicity.Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 0.0)
    assert [r["score"] for r in toxicity.scored(d, model).collect()] == [0.5] * 5
    assert toxicity.scored(d, model, keep_below=0.5).count() == 0 and toxicity.scored(d.limit(0), model).count() == 0
    none = toxicity.fit(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.bias == 0.0 and not len(none.index)


def test_long_texts_score_like_their_pieces(monkeypatch):
    text = b"alpha beta gamma delta rotten " * 200
    model = toxicity.ftrl([(np.array([1, 2, 3]), 1), (np.array([4, 5]), 0)] * 40)
    whole = toxicity.scorer(model)([text])
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 64)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 10)
    assert toxicity.scorer(model)([text]) == pytest.approx(whole)


# ---- op9

def test_mixing_counts(spark, monkeypatch):
    rows = [(i, f"t{i}", "big" if i < 900 else "small") for i in range(1000)] + [(5000, None, None), (None, "x", "small")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(d)
    counts = Counter(r["doc_id"] for r in got.collect())
    rate = {r["source"]: r["mean"] for r in mixing.rates(d).collect()}
    for i, _, source in rows:
        key = f"{mixing.SEED}|{'~' if i is None else i}|{source or '~'}"
        u, k, p = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52, 0, np.exp(-rate[source])
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate[source] / k
            cdf += p
        assert counts.get(i, 0) == k
    assert rate["small"] > 1 > rate["big"] and abs(sum(counts.values()) - len(rows)) < 120
    assert mixing.mixed(d, plain=True).columns == d.columns and mixing.mixed(d.limit(0)).count() == 0
    clashing = d.withColumns({"count": F.lit(7), "__count": F.lit(8), "cdf": F.lit("c"), "OF": F.lit("o"), "a.b": F.lit(1), "mix_key": F.lit(0)})
    again = mixing.mixed(clashing, plain=True)
    assert again.columns == [*d.columns, "count", "__count", "cdf", "OF", "a.b"] and {tuple(r)[3:] for r in again.collect()} == {(7, 8, "c", "o", 1)} and again.count() == sum(counts.values())
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 1)
    assert Counter(r["doc_id"] for r in mixing.mixed(clashing).collect()) == counts
    given = spark.createDataFrame([("small", 1.0)], "source string, weight double")
    assert {r["source"] for r in mixing.mixed(d, given).collect()} == {"small"}


def test_mixing_of_a_large_mean_is_the_sql(spark):
    import duckdb

    rows = "SELECT {id} AS doc_id, 't' AS text, CASE WHEN {id} < 1 THEN 'rare' ELSE 'usual' END AS source FROM range(400000)"
    d = spark.sql(rows.format(id="id"))
    assert max(r["mean"] for r in mixing.rates(d).collect()) > 600
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS " + rows.format(id="range"))
    sums = "source, count(*) AS n, sum(mix_copy) AS c, max(mix_copy) AS m, sum(CAST(mix_key % 1000003 AS BIGINT)) AS k, sum(doc_id * mix_copy) AS d"
    want = con.execute(f"SELECT {sums} FROM ({queries.ORACLES['op9_mixing']}) GROUP BY source ORDER BY source").fetchall()
    mixing.mixed(d).createOrReplaceTempView("mixed_large_mean")
    assert [tuple(r) for r in spark.sql(f"SELECT {sums} FROM mixed_large_mean GROUP BY source ORDER BY source").collect()] == [tuple(map(lambda x: int(x) if not isinstance(x, str) else x, r)) for r in want]


@pytest.mark.parametrize("block", [10_000, 700])
def test_mixing_reaches_given_weights(spark, monkeypatch, block):
    from math import exp, lgamma, log

    monkeypatch.setattr(mixing, "BLOCK", block)
    d = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text", "if(id < 2, 'small', 'big') AS source")
    given = spark.createDataFrame([("small", 1.0), ("big", 1.0)], "source string, weight double")
    got = {r["doc_id"]: (r["n"], r["s"]) for r in mixing.mixed(d, given).filter("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("mix_copy").alias("s")).collect()}
    for i in (0, 1):
        u, k, cdf = int(hashlib.md5(f"{mixing.SEED}|{i}|small".encode()).hexdigest()[:13], 16) / 2**52, 0, 0.0
        while (cdf := cdf + exp(k * log(5000) - 5000 - lgamma(k + 1))) <= u:
            k += 1
        assert got[i] == (k, k * (k + 1) // 2)


# ---- op10

def shingles(t):
    w = (t or "").encode().translate(jaccard.WORD_BYTES).split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = [[j for j, b in enumerate(sets) if j != i and near(a, b)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
    least = defaultdict(list)
    for i, x in enumerate(label):
        least[x].append(rows[i][0])
    return [(rows[i][0], min(v for v in least[label[i]] if v is not None) if any(v is not None for v in least[label[i]]) else None, len(links[i])) for i in range(len(rows))]


def near_copies(seed=9):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(12):
        base = list(r.choice(words, 70))
        out.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for at in r.integers(0, 70, int(r.integers(0, 4))):
                copy[at] = "new"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("run", [jaccard.linked, jaccard.kept])
def test_jaccard_decodes_few_long_texts_at_once(spark, tmp_path, run):
    """Texts of 3 KB are decoded a megabyte at a time; 4096 at once took tens of MB in one array."""
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    spark.createDataFrame([(i, f"w{i} " * 8) for i in range(600)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert run(docs).count() == 600
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) * 3000 <= 1 << 20


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard, "PAIRS", block)
    texts = [*near_copies(), None, "", "", "one two", "One, TWO!", "!!!", "solo"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, "alone here")]
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.linked(repeated(spark, rows)).collect())
    assert got == Counter(brute_links(rows))
    d = repeated(spark, rows).withColumns({"own": F.lit(7), "D": F.lit(8), "a.b": F.lit(9)})
    kept = jaccard.kept(d)
    assert kept.columns == d.columns and {(r["own"], r["D"], r["a.b"]) for r in kept.collect()} == {(7, 8, 9)}
    kept = jaccard.kept(repeated(spark, rows))
    classes = {c if s else ("none", i, t) for (i, t), (_, c, _), s in zip(rows, brute_links(rows), [shingles(t) for _, t in rows])}
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", ") and kept.count() == len(classes)
    assert jaccard.linked(repeated(spark, rows).limit(0)).count() == 0


def depths_of(spark, texts):
    d = repeated(spark, list(enumerate(texts)))
    found, depths = jaccard.joined(d, jaccard.classes(jaccard.signed(d)), jaccard.SHINGLE, jaccard.THRESHOLD)
    return found.agg(F.sum("links")).first()[0], depths


def test_prefixes_shorten_until_the_links_found_reach_the_target(spark):
    body = lambda i, n: " ".join(f"q{i}x{j}" for j in range(n))
    close = [f"{body(i, 400)} {last}" for i in range(400) for last in ("here", "there")]
    assert depths_of(spark, close) == (800, [10])
    edge = [f"{body(i, 12)} {last}" for i in range(1500) for last in ("here", "there")]
    links, depths = depths_of(spark, edge)
    assert links >= 2 * 1499 and depths == [10, 6]
    middle = [f"{body(i, 17)} {last}" for i in range(4000) for last in ("here", "there")]
    links, depths = depths_of(spark, middle)
    assert links >= 7998 and depths == [10, 9]


def test_next_depth_by_brute_force():
    r = np.random.default_rng(3)
    for _ in range(60):
        counts, threshold, trees = r.integers(0, 10 ** r.integers(1, 7), 40), float(r.choice([0.5, 0.8, 0.9])), 32
        for depth in range(jaccard.DEPTH, 0, -1):
            there = [(n + (b == 0)) / (1 - (1 - (threshold + (1 - threshold) * b / 40) ** depth) ** trees) for b, n in enumerate(counts)]
            share = lambda d: sum(t * (1 - (threshold + (1 - threshold) * b / 40) ** d) ** trees for b, t in enumerate(there)) / sum(there)  # noqa: E731, B023
            floor = jaccard.floor_depth(threshold, trees)
            want = None if depth <= floor or share(depth) <= 1 - jaccard.TARGET else max([d for d in range(floor, depth) if share(d) <= 1 - jaccard.TARGET], default=floor)
            assert jaccard.next_depth(counts, depth, threshold, trees) == want


@pytest.mark.parametrize("parts", [1, 7])
def test_forest_is_the_sorted_signatures(spark, parts):
    r = np.random.default_rng(parts)
    heads = r.integers(0, 3, (90, 1 + jaccard.DEPTH))
    rows = []
    for i, h in enumerate(heads):
        keys = np.stack([h, h[::-1]]).astype(">u2")
        keys[:, 0] = (0, 1)
        rows.append((i, 1, bytearray(keys.tobytes())))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = jaccard.forest(spark.createDataFrame(rows, "rid long, n int, sig binary").repartition(parts), 2, 0).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = sorted((bytes(k[i * jaccard.WIDTH : (i + 1) * jaccard.WIDTH]), rid) for rid, _, k in rows for i in (0, 1))
    same = lambda a, b: 0 if a[:2] != b[:2] else next((i for i in range(jaccard.DEPTH) if a[2 + 2 * i : 4 + 2 * i] != b[2 + 2 * i : 4 + 2 * i]), jaccard.DEPTH)
    want = {(k, rid): (same(every[i - 1][0], k) if i else 0, same(k, every[i + 1][0]) if i + 1 < len(every) else 0) for i, (k, rid) in enumerate(every)}
    assert {(bytes(g["key"]), g["rid"]): (g["before"], g["after"]) for g in got} == want


def test_enough_trees_for_low_thresholds():
    for t in (0.05, 0.15, 0.5, 0.8):
        assert jaccard.meeting(t, jaccard.floor_depth(t, jaccard.n_trees(t)), jaccard.n_trees(t)) >= jaccard.TARGET - 1e-12
    with pytest.raises(ValueError, match="target"):
        jaccard.n_trees(0)


def test_low_threshold(spark):
    texts = [" ".join(f"w{i}" for i in range(s, s + 20)) for s in range(0, 60, 4)]
    rows = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    want = {i: sum(j != i and len(a & b) >= 0.3 * len(a | b) - 1e-9 for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert {r["doc_id"]: r["n_links"] for r in jaccard.linked(repeated(spark, rows), threshold=0.3).collect()} == want and any(want.values())


def test_screens_lose_nothing(spark, monkeypatch):
    from quillframe.llm import _base

    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    wanted = rows.filter("id % 100 = 7")
    got = {r["id"] for r in _base.screened(rows, "h", wanted, "h").collect()}
    assert {r["id"] for r in wanted.collect()} <= got and len(got) < 300
    monkeypatch.setattr(_base, "BITMAP", 64)
    assert {r["id"] for r in wanted.collect()} <= {r["id"] for r in _base.screened(rows, "h", wanted, "h").collect()}
    assert _base.screened(rows, "h", wanted.limit(0), "h").count() == 0


def test_pairs_within():
    from quillframe.llm._base import pairs_within

    edges = np.array([0, 3, 4, 4, 9])
    got = [(int(x), int(y)) for a, b in pairs_within(edges, 4) for x, y in zip(a, b)]
    assert got == [(a, b) for s, e in zip(edges, edges[1:]) for a in range(s, e) for b in range(a + 1, e)]


def test_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in r.integers(1, 40, 70)]
    got = jaccard.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


# ---- all

def test_every_number_has_one_query():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def pipeline_folder(spark, tmp_path, rows, items):
    labels = [(i, 0, int("rotten" in t)) for i, t, *_ in rows if t and i is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(words, 40)) + (" rotten filth " + " ".join(r.choice(words, 10)) if i % 5 == 0 else "") for i in range(200)]
    items = [(0, texts[1][:80]), (1, None), (2, "")]
    texts += [texts[3], texts[3] + " more", texts[7], None, None, "", "", "solo"]
    rows = [(i, t, "en", (None, "a", "b")[min(2, i % 7)], 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "a", 1), (None, texts[8], "en", "b", 1)]
    sf = pipeline_folder(spark, tmp_path, rows, items)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    score = toxicity.scorer(toxicity.fit(d, spark.read.parquet(f"{sf}/labels.parquet")))
    kept = [x for x, v in zip(rows, score([None if x[1] is None else x[1].encode() for x in rows])) if v < toxicity.THRESHOLD]
    assert 0.7 * len(rows) < len(kept) < len(rows) - 30
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    sets, label = [shingles(x[1]) for x in kept], list(range(len(kept)))
    for _ in range(3):
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    chosen = {}
    for x, c, a in zip(kept, label, sets):
        group = c if a else ("own", x[0], x[1])
        if group not in chosen or key(x) < key(chosen[group]):
            chosen[group] = x
    clean = [x for x in chosen.values() if not brute_hits(x[1], items)[1]]
    assert len(clean) < len(chosen) < len(kept)
    n = Counter(x[3] for x in clean)
    total, out = sum(v**0.5 for v in n.values()), Counter()
    for x in clean:
        mean = n[x[3]] ** 0.5 / total * len(clean) / n[x[3]]
        u, k = int(hashlib.md5(f"{mixing.SEED}|{'~' if x[0] is None else x[0]}|{x[3] or '~'}".encode()).hexdigest()[:13], 16) / 2**52, 0
        cdf = p = np.exp(-mean)
        while cdf <= u:
            k, p = k + 1, p * mean / (k + 1)
            cdf += p
        if k:
            out[(x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode()))] += k
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == out
    check_shards(got, got, sharding.N_SHARDS)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, pipeline_folder(spark, tmp_path, [], [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontamination", "mixing", "sharding"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d.withColumn("extra", F.lit(1)), "/root/testdata/sf0.001").columns == [*d.columns, "extra"]
