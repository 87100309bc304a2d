"""Golden cases of the functions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions import analysis, dates, lifecycle, markers, text, urls
from tidemark.operators import scoring
from tidemark.sources import announcements


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first().r


def test_ranges(spark):
    got = one(spark, "参赛团队报名时间：2026年6月1日8:00至9月19日17:00", dates.date_range)
    assert (got.start, got.end) == (dt.datetime(2026, 6, 1, 8), dt.datetime(2026, 9, 19, 17))
    got = one(spark, "报名时间：2026年9月19日8:00至6月1日17:00", dates.date_range)
    assert got.start is None and got.end is None
    assert one(spark, "2026年2月30日", dates.parse_date) is None
    assert one(spark, "2026年3月1日 24:00", dates.parse_date) == dt.datetime(2026, 3, 1, 23, 59)


def test_dates_read_their_text_once(spark):
    """Each date is matched once, not once for each of its parts at each use."""
    for read in (dates.registration_dates, dates.competition_dates, dates.date_range):
        plan = spark.range(1).select(F.lit("x").alias("said")).select(read(F.concat("said", F.lit("y"))))._jdf.queryExecution().analyzed().toString()
        assert plan.splitlines()[0].count("said#") == 1, read
    assert one(spark, "报名时间：2026年6月1日至9月19日", dates.registration_dates).end == dt.datetime(2026, 9, 19)
    assert one(spark, "2026年2月1日 9时至3月2日", dates.date_range) == (dt.datetime(2026, 2, 1, 9), dt.datetime(2026, 3, 2))
    assert one(spark, "2026年2月1日至2026年1月2日", dates.date_range) == (None, None) == one(spark, "", dates.date_range)


def test_labels_and_gate_read_their_text_once(spark):
    """A text is searched for all terms in one pass, not once for each list of them."""
    row = spark.range(1).select(F.lit("x").alias("said"), F.lit("high").alias("trust"), F.lit(None).cast("timestamp").alias("ends"))
    plan = lambda c: row.select(c)._jdf.queryExecution().analyzed().toString().split("\n+- ")[0]
    assert plan(analysis.profile(F.concat("said", F.lit("y")), F.lit(""))).count("said#") == 1
    gate = analysis.catalogue_eligible(F.lit(""), F.concat("said", F.lit("y")), F.lit(""), F.col("ends"), F.lit(""), F.col("trust"))
    assert plan(gate).count("said#") == 1


def test_terms_of_a_text(spark):
    """All terms are found that plain Python finds, also overlapping ones and those within others."""
    rng = random.Random(16)
    lists = [analysis.LABEL_TERMS, analysis.GATE_TITLE_TERMS, analysis.GATE_TEXT_TERMS, markers.REGIONS, ["a", "ab", "abc", "bc", "c.", "\\E", "[", "^", "𠮷b", "𠮷"]]
    for terms in lists:
        letters = sorted({c for t in terms for c in t})
        cut = lambda t: t[rng.randrange(len(t)) :] if rng.random() < 0.3 else t[: rng.randrange(len(t)) + 1]
        texts = ["".join(rng.choice([rng.choice(terms), cut(rng.choice(terms)).upper(), rng.choice(letters), " ", "\n", "𠮷"]) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", *terms]
        got = spark.createDataFrame([(x,) for x in [*texts, None]], "v string").select("v", text.terms_in(F.col("v"), terms).alias("f"), text.has_any(text.terms_in(F.col("v"), terms), terms[:3]).alias("h")).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            want = {t.lower() for t in terms if t.lower() in (r.v or "").lower()}
            assert set(r.f) == want and r.h is bool(want & {t.lower() for t in terms[:3]}), r


def test_keys_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Tasks grow with the table, whatever number of cores the session knows of."""
    monkeypatch.setattr(announcements, "KEYS_A_TASK", 10)
    spark.range(95).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    keys = announcements._keys(spark, str(tmp_path), "orders", "o_orderkey")
    assert keys.rdd.getNumPartitions() == 10 and keys.count() == keys.distinct().count() == 95
    spark.range(0).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/none/orders.parquet")
    assert announcements._keys(spark, f"{tmp_path}/none", "orders", "o_orderkey").count() == 0


def test_next_delivery(spark):
    now = F.lit("2026-08-03 01:30:00").cast("timestamp")
    due = spark.range(1).select(dates.next_delivery(now, F.lit("daily"), F.lit(8), F.lit(0), F.lit(1), F.lit("Asia/Shanghai")).alias("r")).first().r
    assert due == dt.datetime(2026, 8, 4, 0, 0)


def test_text(spark):
    assert one(spark, " a　 b ", text.normalize_space) == "a b"
    assert one(spark, "第十届 2026 比赛", text.edition) == "第十届"
    assert one(spark, "x。前面报名截止后面。y", lambda c: text.evidence_window(c, ["无", "截止"])) == "前面报名截止后面"
    assert one(spark, "a longer sentence。\n截止 b", lambda c: text.evidence_window(c, ["截止"])) == "截止 b"  # a line end right before the marker
    assert one(spark, "before it\n截止 b", lambda c: text.evidence_window(c, ["截止"])) == "截止 b"
    assert one(spark, "b,a;a，c", text.keyword_list) == ["a", "b", "c"]
    assert one(spark, "A long title | site", text.clean_title) == "A long title"


def test_urls(spark):
    assert one(spark, " https://a.b/c?z=1&utm_x=2&a=3#f", urls.canonical_url) == "https://a.b/c?a=3&z=1"
    for url, ok in (("http://10.1.2.3/", False), ("http://8.8.8.8/", True), ("ftp://a.b", False), ("http://localhost/", False), ("https://a.b/", True)):
        assert one(spark, url, urls.public_url) is ok
    cases = {
        "https://a.b/c?UTM_Source=x&a=2&a=1&Spm=3#f": "https://a.b/c?a=2&a=1",
        "https://a.b/c?z=%E4%BD%A0&q=a+b&q2=a%20b": "https://a.b/c?q=a+b&q2=a+b&z=%E4%BD%A0",
        "https://a.b/c?from=x": "https://a.b/c",
        "https://mp.weixin.qq.com/mp/wappoc_appmsgcaptcha?poc=1&target_url=https%3A%2F%2Fmp.weixin.qq.com%2Fs%2Fabc%3Futm_x%3D1%26k%3D2": "https://mp.weixin.qq.com/s/abc?k=2",
    }
    for url, want in cases.items():
        assert one(spark, url, urls.canonical_url) == want
    six = {"::1": False, "::": False, "fe80::1": False, "fd00::2": False, "ff02::1": False, "2001:db8::1": True, "::ffff:127.0.0.1": False, "::ffff:8.8.8.8": True, "2001:4860:4860::8888": True, "1:2:3": False, "x": False}
    for address, ok in six.items():
        assert one(spark, address, urls.public_ipv6) is ok, address
    assert one(spark, "http://[::1]/", urls.public_url) is False and one(spark, "http://[2001:4860:4860::8888]/", urls.public_url) is True
    for address, ok in {"192.0.2.1": True, "198.51.100.2": True, "192.0.0.9": False, "240.1.1.1": False, "100.64.0.1": False}.items():
        assert one(spark, address, urls.public_ipv4) is ok
    assert one(spark, "http://sub.Example.org/x", lambda c: urls.allowed_url(c, [".example.org"])) is True


def test_confidence(spark):
    sure = spark.range(1).select(
        lifecycle.fact_confidence(F.lit("high"), F.lit("long evidence"), F.lit("2026"), F.lit("d")).alias("a"),
        lifecycle.fact_confidence(F.lit("low"), F.lit("long evidence"), F.lit("2026"), F.lit("d")).alias("b"),
    ).first()
    assert (sure.a, sure.b) == ("high", "low")


def packed(value, most):
    """Segments as a plain loop makes them."""
    done, current = [], ""
    for part in (" ".join(p.split()) for p in value.replace("。", "。\n").split("\n")):
        if not part:
            continue
        if current and len(current) + len(part) > most:
            done.append(current)
            current = ""
        if len(part) > most:
            done += [part[i : i + most] for i in range(0, len(part), most)]
        else:
            current = f"{current} {part}" if current else part
    return done + [current] * bool(current)


def test_segments(spark):
    for value in ("", " \n ", "ab cd\nef\n\ngh。ij", "x" * 25, "abc\n" + "y" * 21 + "\nz", "a b。" * 9, "一二三四五六七八九十。" * 3):
        for most in (7, 10):
            assert one(spark, value, lambda c, most=most: text.segments(c, most)) == packed(value, most)
    assert one(spark, None, text.segments) == []


def test_registration_dates(spark):
    day = lambda k: dt.datetime(2026, 6, k)
    cases = {
        "报名时间：2026年6月1日至6月9日": (day(1), day(9)),
        "报名开始：2026年6月1日。报名截止：2026年6月5日": (day(1), day(5)),
        "报名时间：2026年6月9日至6月1日": (None, None),
        "报名截止：2026年6月5日。注册截止：2026年6月6日": (None, None),
        "nothing": (None, None),
    }
    for value, want in cases.items():
        got = one(spark, value, dates.registration_dates)
        assert (got.start, got.end) == want, value


def test_competition_dates(spark):
    at = lambda *d: dt.datetime(2026, *d)
    cases = {
        "比赛时间：2026年7月25日至26日": (at(7, 25), at(7, 26), "2026年7月25日", "26"),
        "大赛将于2026年4月25~26日举行": (at(4, 25), at(4, 26), "2026年4月25", "26"),
        "比赛时间：2026年4月30日~2日": (None, None),
        "比赛时间：2026年4月25日9:00至26日18:00": (None, None),
        "报名将于2026年4月25日至26日进行": (None, None),
        "比赛报名将于2026年4月1日至2日进行。比赛时间：2026年4月25日至26日": (at(4, 25), at(4, 26)),
        "竞赛时间：2026年6月1日 8:00 至 9月19日 17时30分": (at(6, 1, 8), at(9, 19, 17, 30)),
        "开赛时间：2026年6月1日。比赛结束：2026年6月3日": (at(6, 1), at(6, 3)),
        "比赛时间：2026年9月19日至6月1日": (None, None),
        "nothing": (None, None),
    }
    for value, want in cases.items():
        got = one(spark, value, dates.competition_dates)
        assert (got.start, got.end, got.start_raw, got.end_raw)[: len(want)] == want, value
    narrow = spark.range(1).select(dates.only_day_range(F.lit("2026-04-25").cast("timestamp"), F.lit("2026-04-26").cast("timestamp"), F.lit("2026年4月25日"), F.lit("26日")).alias("r"))
    assert narrow.first().r is True


def test_lists_of_words(spark):
    assert one(spark, "B,b,a\n b ；C", text.keyword_list) == ["B", "C", "a"]
    assert one(spark, ",".join("k%d" % i for i in range(21)), text.keyword_list) is None
    assert one(spark, "x" * 41, text.keyword_list) is None
    assert one(spark, "重庆市、四川省".replace("、", ","), text.region_list) == ["四川", "重庆"]
    assert one(spark, "内蒙古自治区,广西壮族自治区", text.region_list) == ["内蒙古", "广西"]
    assert one(spark, "火星", text.region_list) is None
    assert one(spark, "/a/b/c.pdf/", text.path_title) == "c.pdf" and one(spark, "/", text.path_title) == ""
    assert one(spark, " ", lambda c: text.first_non_empty(c, F.lit("x"))) == "x" and one(spark, None, lambda c: text.first_non_empty(c)) == "暂未公布"
    assert one(spark, "（校级） 选拔，赛", text.marker_text) == "校级选拔赛"


def test_scores_of_candidates(spark):
    score = lambda title, snippet: one(spark, title, lambda c: scoring.candidate_score(c, F.lit(snippet), scoring.FIELD))
    assert score("CCPC 获奖名单", "程序设计 算法") == -100
    assert score("人工智能 算法 编程 摄影", "") == 25
    assert score("摄影大赛", "") == -100 and score("CCPC", "") == 100


def test_status_of_pages(spark):
    said = lambda v: one(spark, v, analysis.detect_status)
    assert said("报名已截止。比赛将于七月开赛").status == "upcoming"
    assert tuple(said("欢迎！现已开放报名，速来；其他")) == ("registration_open", "现已开放报名，速来")
    assert said("无") is None
    assert one(spark, "参赛费：100元/人。", analysis.fee).fee == "100元/人" and one(spark, "免费报名", analysis.fee).fee == "免费"
    assert one(spark, "请 开启 JavaScript 后继续", analysis.challenge_page) is True


def test_urls_of_other_spellings(spark):
    """Schemes in any case, spaces in paths, ports, and dots after hosts."""
    cases = {
        "HTTPS://e.com/A b?b=1&UTM_x=2&a=c%20d#f": "https://e.com/A%20b?a=c+d&b=1",
        "HtTp://e.com": "http://e.com",
        " http://e.com/%E4%B8%AD ": "http://e.com/%E4%B8%AD",
    }
    rows = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert all(r.got == r.want for r in rows.select("want", urls.canonical_url(F.col("url")).alias("got")).collect())
    safe = {"http://localhost./": False, "http://a.localhost.": False, "http://e.com:0/": False, "http://e.com:99999/": False, "http://e.com:443/": True, "https://e.com.": True, "http://[::1]:80/": False, "HTTPS://e.com": True}
    rows = spark.createDataFrame(list(safe.items()), "url string, want boolean")
    assert [r.url for r in rows.withColumn("got", urls.public_url(F.col("url"))).collect() if r.got != r.want] == []


def test_links_of_a_page(spark):
    """What a reference means on its page, and which links count."""
    base = "https://e.com/a/b/c?q=1#f"
    cases = {"d": "/a/b/d", "./d": "/a/b/d", "../d?x=1": "/a/d?x=1", "../../../d": "/d", "/x/./y/..": "/x/", "?z": "/a/b/c?z", "#g": "/a/b/c?q=1#g", "": "/a/b/c?q=1", "d/": "/a/b/d/"}
    rows = spark.createDataFrame([(k, "https://e.com" + v) for k, v in cases.items()] + [("//o.org/x", "https://o.org/x"), ("mailto:a@b", "mailto:a@b"), ("HTTP://O.org", "HTTP://O.org")], "href string, want string")
    assert [(r.href, r.got) for r in rows.withColumn("got", urls.resolved(F.lit(base), F.col("href"))).collect() if r.got != r.want] == []
    html = '<a href="/rel?utm_a=1">比赛报名 one</a><a href="http://127.0.0.1/x">private one</a><a href="/für">words</a><a href="/rel">the same again</a><a href="javascript:x">script link</a>'
    pages = spark.createDataFrame([(1, base, html), (2, None, html)], "page_id long, url string, html string")
    got = scoring.candidates(pages, scoring.FIELD, 10).orderBy("page_id", "place").collect()
    assert [(r.page_id, r.place, r.url) for r in got] == [(1, 1, "https://e.com/a/b/c?q=1"), (1, 2, "https://e.com/rel"), (1, 3, "https://e.com/f%C3%BCr")]
