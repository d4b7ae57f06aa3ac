"""Divergence audit, conversation repair and URL filters against brute force, on nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import divergence, turn_repair, url_filter
from shelfcast.llm.turn_repair import AFTER, NEXT, Bound, Turn

# ------------------------------------------------------------------ divergence audit

DOCS = "doc_id long, text string, lang string, source string, n long, docs long, term string, kept string, value string"


def audit_rows():
    rng = random.Random(3)
    words = ["The", "the", "é", "Ünder", "cat", "dog", "x1y", "a-b", "Straße", "日本", "\u00a0q", "zz"] + ["w" + "abcdefgh"[i % 8] * (i // 8 + 1) for i in range(40)]
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "en", "de", None, "", "x"])
        source = rng.choice(["s0", "s0", "s0", "s1", "é", "𝄞", "\uffee", None])
        text = " ".join(rng.choice(words[:rng.randint(2, len(words))]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text if i % 17 else None, lang, source))
    rows += [rows[5]] * 3 + [(None, "cat " * 20_000, "en", "s1"), (1, "y" * 50_000, "en", "s2"), (2, "", "solo", "only"), (3, "rare", "two", "a"), (4, "", "two", "b")]
    return rows


def audit_brute(rows, min_docs, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t in docs[lang] if docs[lang][t] >= min_docs]
        in_lang = {t: sum(n[g][t] for g in groups if g[0] == lang) for t in kept}

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def far(p, q):
            return (p - q) * (p - q) // (p + q)
        p, q = share(n[lang, source]), share(in_lang)
        pairs = []
        for _, other in (g for g in groups if g[0] == lang and g[1] != source):
            r = share(n[lang, other])
            pairs.append((-sum(far(p[t], r[t]) for t in kept), other.encode(), other))
        terms = sorted((-far(p[t], q[t]), t.encode(), t) for t in kept if n[lang, source][t] > 0 and p[t] > q[t])[:top]
        for part, found in (("pair", sorted(pairs)), ("term", terms)):
            out += [(lang, source, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(*r, 1, 2, "t", "k", "v") for r in audit_rows()]
    return spark.createDataFrame(rows, DOCS).repartition(6)


@pytest.mark.parametrize("held,cells", [(divergence.HELD_TERMS, divergence.BLOCK_CELLS), (20, 40)])
def test_audit(texts, held, cells, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    got = divergence.audit(texts, min_docs=3, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit_brute(audit_rows(), 3, 4)


def test_audit_of_few_and_no_rows(spark, texts):
    assert divergence.audit(texts.limit(0)).count() == 0
    rows = [(1, "rare", "two", "a"), (2, None, "two", "b")]
    got = divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(map(tuple, got.collect())) == audit_brute(rows, 10, 10) == [("two", "a", "pair", "b", 0, 1), ("two", "b", "pair", "a", 0, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_skyband(seed):
    rng = np.random.default_rng(seed)
    n, lang_n = rng.integers(1, 12, 900), rng.integers(1, 30, 900)
    terms = [("t%d" % i if i % 3 else "é%d" % i).encode() for i in rng.permutation(900)]
    want = [i for i in range(900) if sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and terms[j] < terms[i] for j in range(900)) < 3]
    assert sorted(divergence.skyband(terms, n, lang_n, 3).tolist()) == want
    assert len(divergence.skyband([], n[:0], lang_n[:0], 3)) == 0


def test_pairs_of_blocks_that_meet_the_sources_in_another_order():
    sources = ["s0", "é", "𝄞", "a"]
    rows = [("en", s, None, 10 + i) for i, s in enumerate(sources)] + [("en", s, t, 100 * i + j) for j, t in enumerate(["t", "u"]) for i, s in enumerate(sources)]
    columns = ["lang", "source", "term", "p"]

    def sums(order):
        t = divergence._pair_table(pa.table(dict(zip(columns, map(list, zip(*order))))))
        return sorted(zip(*(t.column(c).to_pylist() for c in ("lang", "a", "b", "value"))))
    assert sums(rows) == sums(rows[::-1]) == sums(rows[2:] + rows[:2])
    assert len({frozenset(r[1:3]) for r in sums(rows)}) == len(sums(rows)) == 6


def test_share_does_not_overflow(spark):
    n, total, kept = 4 * 10 ** 12, 9 * 10 ** 13, 10 ** 9
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(divergence.share("n", "total", "kept")).first()
    assert row[0] == 1 + 10 ** 9 * (n + 2) // (total + 2 * kept)


# ------------------------------------------------------------------ conversation repair

def cheapest(rows):
    """(price, audit) by dynamic programming over rows and states, least audits first among equals."""
    none = (10 ** 9, "~")
    after = {s: (0, "") if s in (0, 3) else none for s in range(4)}

    def with_inserts(best):
        for _ in range(5):
            best = {s: min(best[s], (2 + best[NEXT[s]][0], "I" + best[NEXT[s]][1])) for s in best}
        return best
    best = with_inserts(after)
    for row in reversed(rows):
        here = {}
        for s in range(4):
            found = [(3 + best[s][0], "D" + best[s][1])]
            if not row.forced:
                to = s if not row.initial else AFTER.get((s, row.initial))
                found += [] if to is None else [(row.truncated + best[to][0], "K" + best[to][1])]
                found.append((2 + row.truncated + best[NEXT[s]][0], "R" + best[NEXT[s]][1]))
            here[s] = min(found)
        best = with_inserts(here)
    return best[0]


def turns(rng, n, roles):
    rows = [Turn(rng.choice(roles), rng.random() < 0.15, rng.random() < 0.25) for _ in range(n)]
    return [r._replace(truncated=r.truncated and not r.forced) for r in rows]


@pytest.mark.parametrize("stretch", [turn_repair.STRETCH, 1, 3])
def test_search_is_cheapest_and_least(stretch, monkeypatch):
    monkeypatch.setattr(turn_repair, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(2500):
        rows = turns(rng, rng.randint(0, 9), ["u", "a", "u", "a", "s", "x", ""])
        want = cheapest(rows)
        assert turn_repair.repair(rows) == want and Bound(rows)(0, 0) <= want[0]


def test_search_of_a_long_conversation():
    rows = turns(random.Random(9), 5000, "uuasx")
    price, audit = turn_repair.repair(rows)
    assert price == cheapest(rows)[0] and re.fullmatch("(D|I|K|R)+", audit)


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, gone string, again int, how string, audit string"


def conversations():
    rng = random.Random(4)
    rows = []
    for conv in range(250):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "system" if turn == 0 and rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "Why?\n", "cut off", "", " \t\n", "ok. ", "a.b", f"t{rng.randint(0, 99)}.", "é", "…"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice([role] * 12 + [None, "", "tool"]), text if rng.random() < 0.95 else None))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 1, "user", "Hi."), (900, None, "user", "x" * 100_000)]
    rows += [(901, t, ("user", "assistant")[t % 2], "same." if t % 5 else "t%d" % t) for t in range(700)]
    rows += [(1000 + c, 0, "user", "only.") for c in range(40)]
    return rows + rows[:9]


def repair_brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = "user" if how == 4 else show(role), "" if how == 1 else re.sub("[.!?]", "", show(text)) if how == 2 else show(text)
        by[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(how, 1)
    out = []
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds = set(), []
        for _, role, text in found:
            solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
            kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in found]
        price, audit = cheapest([Turn(i if i in ("u", "a", "s", "") else "x", k in ("blank", "duplicate"), k == "truncated") for i, k in zip(initials, kinds)])
        state, at, lines = 0, 0, []
        for edit in audit:
            if edit == "I":
                state = NEXT[state]
                lines.append(("user:", "assistant:")[state == 3])
                continue
            _, role, text = found[at]
            at += 1
            if edit == "K":
                state = AFTER[state, role[0]] if role else state
                lines.append(f"{role}:{text}")
            elif edit == "R":
                state = NEXT[state]
                lines.append(("user:", "assistant:")[state == 3] + text)
        numbers = {r[0] for r in found if r[0] is not None}
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), price, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def test_repair(spark, tmp_path):
    data = [(*r, "k", "g", 1, "h", "z") for r in conversations()]
    spark.createDataFrame(data, CONVERSATIONS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = turn_repair.op12_turn_repair(spark, str(tmp_path)).collect()
    want = repair_brute(conversations())
    assert got[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(repr, map(tuple, got))) == want
    assert any("''" in w for w in want), "a conversation without rows"


def test_repair_of_no_rows(spark):
    reports, rows = turn_repair.repair_conversations(turn_repair.damaged(spark.createDataFrame([], CONVERSATIONS)))
    assert reports.count() == rows.count() == 0


def test_repaired_rows_are_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More?"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", " ")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("gone", F.lit(False))
    reports, fixed = turn_repair.repair_conversations(frame)
    assert [tuple(r) for r in reports.collect()] == [(1, 0, 1, 0, 0, 2, 5, "KIKKD")]
    assert [tuple(r) for r in fixed.orderBy("position").collect()] == [
        (1, 0, "K", 0, "user", "Hi."), (1, 1, "I", None, "assistant", ""), (1, 2, "K", 1, "user", "More?"), (1, 3, "K", 2, "assistant", "Yes.")]


# ------------------------------------------------------------------ URL filters

PAGES = "page_id long, url string, html string, host string, rule string, blocked boolean, score long, __rule string, __host string"


def pages():
    def link(*hosts):
        return "".join(f'<p>x</p><a class=b HREF = "{h}">y</a>' for h in hosts)
    rows = [
        (1, "https://a.net/x", link("//spam.com/1", "/local", "http://hub.com?q", "http://hub.com/again")),
        (2, "http://spam.com/de", link("https://A.NET/")), (3, "http://spam.com/x#://b", link("http://a.net", "http://b.net#t")),
        (4, "http://hub.com/1", link(*[f"http://h{i}.com/" for i in range(20)], "http://spam.com/")),
        (5, "http://good.org/fr/1", link("http://fine.com/", "http://hub.com/")), (6, "http://fine.com", None),
        (7, "https://b.NET/", ""), (8, "https://b.net", None), (9, "ftp://x.example.net/en/1?p=://z/", link("http://fine.com/")),
        (10, "http://example.net/en/", None), (11, "http://example.net/enx", None), (12, "http://notexample.net/en/", None),
        (13, "http://www.example.com/de/1", None), (14, "http://www.example.com/en/1", None), (15, "http://www.example.com/de", None),
        (16, None, link("http://spam.com/")), (17, "no scheme", link("http://b.net/")), (18, "", None), (19, "x://", None), (20, "http://?q", None),
        (21, "http://ÄB.Net/é?x", None), (22, "http://net", None), (23, "http://org/fr/", None), (24, "http://u@a.net:80/", None),
        (25, "a\nb://Line.org/fr/\n1?2", "z" * 200_000 + link("http://spam.com/")), (None, "http://b.net", link("http://spam.com/")), (1, "https://a.net/x", None),
        (26, "://start.com/p", 'href="http://a.net/' + "<a " * 20_000)]
    return rows + [(100 + i, f"http://farm{i % 7}.com/{i}", link("http://b.net/", "http://a.net/", f"http://farm{(i + 1) % 7}.com/")) for i in range(60)]


def filter_brute(rows):
    def parts(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)
    n, good, bad, weight = Counter(), Counter(), Counter(), Counter()
    for _, url, html in rows:
        host, path = parts(url)
        if host:
            n[host] += 1
            good[host] += rule(host, path)[1] == "allow"
            bad[host] += rule(host, path)[1] == "block"
            for to in {re.sub("[A-Z]", lambda x: x[0].lower(), x) for x in re.findall(url_filter.LINK, html or "")}:
                weight[host, to] += to != host

    def spread(seed, edges):
        total = Counter()
        for (a, _), w in edges.items():
            total[a] += w
        fresh = {h: 150_000_000 * c // n[h] for h, c in seed.items() if c}
        score = Counter(fresh)
        for _ in range(url_filter.ROUNDS):
            out = Counter()
            for (a, b), w in edges.items():
                if w and a in fresh:
                    out[b] += fresh[a] * 85 * w // (100 * total[a])
            fresh = +out
            score.update(fresh)
        return score
    trust, distrust = spread(good, weight), spread(bad, Counter({(b, a): w for (a, b), w in weight.items()}))
    out = []
    for i, url, _ in rows:
        host, path = parts(url)
        r, v = rule(host, path)
        out.append((i, host, path, r, v or ("block" if distrust[host] - trust[host] >= 75_000_000 else "allow")))
    return sorted(map(repr, out))


def test_url_filter(spark):
    frame = spark.createDataFrame([(*r, "h", "r", False, 1, "x", "y") for r in pages()], PAGES).repartition(4)
    got = sorted(map(repr, map(tuple, url_filter.filter_urls(frame).collect())))
    assert got == filter_brute(pages())
    verdicts = {eval(g)[0]: eval(g)[3:] for g in got}
    assert verdicts[100] == (None, "block") and verdicts[6] == (None, "allow") and verdicts[9] == ("example.net/en/", "allow")
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string")
    hosts = {r.host: r for r in url_filter.judge_hosts(frame).collect()}
    assert hosts["fine.com"].trust > 0 and hosts["fine.com"].distrust == 0
    assert hosts["farm0.com"].distrust > 0 and hosts["farm0.com"].trust == 0 and hosts["farm0.com"].blocked
