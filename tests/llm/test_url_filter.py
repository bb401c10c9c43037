import math
import random
import re
from collections import Counter

from tallyforge.llm import url_filter as uf
from tallyforge.llm.queries import RULES

PLAIN = str.maketrans(uf.UPPER, uf.LOWER)


def parsed(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(PLAIN), re.match(r"[^?#]*", rest[len(host):])[0]


def by_rule(host, path):
    fits = [r for r in RULES for name, _, rest in [r.pattern.partition("/")]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return max(fits, key=lambda r: len(r.pattern), default=None)


def cut(name, counts):
    """All ways to cut a name, one by one."""
    total = max(sum(counts.values()), 1)

    def ways(n):
        if n == 0:
            yield []
        for a in range(max(0, n - uf.LONGEST), n):
            for w in ways(a):
                yield [*w, name[a:n]]

    def score(words):
        return round(sum((math.log(counts[w]) if counts.get(w) else -math.log(10) * len(w)) - math.log(total) for w in words), 6)

    return max(ways(len(name)), key=lambda w: (score(w), [len(x) for x in reversed(w)]))


def brute(rows):
    counts = Counter()
    for _, _, html in rows:
        counts.update(w for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", html or "").translate(PLAIN)) if len(w) <= uf.LONGEST)

    def tokens(host, path):
        out = []
        for piece in re.findall("[a-z]+|[0-9]+", host):
            out += ["h:" + w for w in cut(piece, counts)] if piece[0].isalpha() else ["h:0"]
        return out + ["p:" + (w if w[0].isalpha() else "0") for w in re.findall("[a-z]+|[0-9]+", path.translate(PLAIN))]

    seen = {v: Counter() for v in ("allow", "block")}
    pages = Counter()
    for _, url, _ in rows:
        if r := by_rule(*parsed(url)):
            seen[r.verdict].update(tokens(*parsed(url)))
            pages[r.verdict] += 1
    vocabulary = set(seen["allow"]) | set(seen["block"])
    out = []
    for page, url, _ in rows:
        host, path = parsed(url)
        r = by_rule(host, path)
        score = math.log((pages["block"] + 1) / (pages["allow"] + 1))
        for t in tokens(host, path):
            if t in vocabulary:
                score += math.log((seen["block"][t] + 1) / (sum(seen["block"].values()) + len(vocabulary) + 1))
                score -= math.log((seen["allow"][t] + 1) / (sum(seen["allow"].values()) + len(vocabulary) + 1))
        out.append((page, host, path, r and r.pattern, r.verdict if r else "block" if score > uf.TIE else "allow", None if r else round(score, 6)))
    return out


def pages():
    rng = random.Random(3)
    words = ["news", "shop", "the", "there", "red", "are", "ear"]
    rows = []
    for i in range(250):
        name = "".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))[:12]
        end = rng.choice(["example.com", "www.example.com", "a.com", "x.net", "b.org"])
        path = rng.choice(["", "/en/", "/EN/", "/es/1", "/fr/news-77", "/de/shop?q=http://z.net/es/", "/en#x"])
        html = f"<p class=x>{rng.choice(words)} <b>{rng.choice(words).upper()}</b> {rng.choice(words)}" if i % 7 else None
        rows.append((i, f"{rng.choice(['http', 'https', ''])}://{name}.{end}{path}", html))
    rows += [(1000, None, None), (1001, "", ""), (1002, "no scheme.com/en/", "x"), (1003, "http://", "x"), (1004, "http://example.com", "x"),
             (1005, "http://Example.COM/en/", "x"), (1006, "http://badexample.com/en/", "x"), (1007, "http://net/es/", "x"),
             (1008, "a\nb://É9shop.org/É/fr", "É"), (1008, "a\nb://É9shop.org/É/fr", "É"), (None, "http://www.example.com/en/x", "<"),
             (1009, "http://a.b?x://c.com/", "x")]
    return rows


def test_against_brute_force(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").selectExpr(
        "*", "url as host", "1 as path", "2 as row", "3 as rule", "4 as word", "5 as n")
    got = uf.judge(df, RULES).select("row.page_id", "host", "path", "rule", "verdict", "score").collect()
    key = lambda r: tuple(map(str, r))
    got = [(*r[:5], r.score if r.score is None else round(r.score, 6)) for r in got]
    assert sorted(got, key=key) == sorted(brute(pages()), key=key)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}
    assert uf.judge(df.limit(0), RULES).count() == 0


def test_names_are_cut_into_words():
    counts = {"weather": 50, "report": 40, "we": 500, "at": 500, "her": 300, "rep": 5, "ort": 1}
    assert uf.viterbi("weatherreport", counts, sum(counts.values())) == ["weather", "report"]
    assert uf.viterbi("zzweather", counts, sum(counts.values())) == ["zz", "weather"]
    assert uf.viterbi("abc", {}, 0) == ["abc"] and uf.viterbi("", counts, 9) == []


def test_without_decided_pages_all_are_allowed(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", None), (1, None, None)], "page_id long, url string, html string")
    assert [(r.verdict, r.rule, r.score) for r in uf.judge(df, RULES).collect()] == [("allow", None, 0.0)] * 2
