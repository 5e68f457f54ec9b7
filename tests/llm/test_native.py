"""Native text operators next to plain Python on small tables with nulls, ties and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from flowlake.llm import decontaminate, line_rules, shards, url_filter

DOCS = "doc_id bigint, text string, _facts int, host string, h bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    words = "the of and in éa ß 中文 x| #a $$ on re th nd".split()
    out: list[str | None] = [None, "", " ", "\n\n", "a", "a b", "a b a b a b", "x " * 4000, "word.\n" * 30, "| | |\nHome | News | About\nA line that ends well enough here."]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\u00a0", ". "]) for _ in range(rng.randint(0, 120))))
    return out + out[:12]


def doc_table(spark, rows):
    return spark.createDataFrame([(i if i % 9 else None, t, i, "h", i) for i, t in enumerate(rows)], DOCS)


def test_word_figures_match_plain_python(spark):
    rows = texts()
    got = line_rules.judge(doc_table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["h"]] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert r["host"] == "h" and not (r["kept"] and r["base_failed"])


def test_lines_are_removed_and_documents_rejected(spark):
    good = "This line has quite a few words and it ends with a full stop. " * 6
    junk = "Home | News | About | Contact\n" * 40
    rows = [good, good + "\nHome | News | About | Contact\n", junk + good, "Read our privacy policy here.\n" + good]
    got = {r["h"]: r for r in line_rules.judge(doc_table(spark, rows), max_repeat_pct=100).collect()}
    assert [got[i]["kept"] for i in range(4)] == [True, True, False, True]
    assert [got[i]["n_lines_removed"] for i in range(4)] == [0, 1, 40, 1]
    assert "privacy" not in got[3]["clean_text"] and got[1]["clean_text"] == good


def brute_url(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    key = re.sub(r"^(www|m)\.", "", re.sub(r":[0-9]*$", "", host)) + re.sub(r"(\.html|/)$", "", path) if host else None
    return host, path, best and best[1] + best[2], best[0] if best else ("block" if key in listed else "allow")


def test_urls_match_plain_python(spark):
    urls = [
        None, "", "no scheme", "http://", "http://COM/", "https://Example.com/en/1", "https://www.example.com/en/x?q=1", "http://a.www.example.com/en/",
        "http://x.net/es/1", "http://x.net/fr/1#t", "http://xnet/es/", "http://notexample.com/en/a", "http://bad.org/a/", "http://m.bad.org/a.html?u=1",
        "https://www.bad.org:80/a", "http://good.org/a://b/c", "http://bad.org", "http://example.com", "http://ünï.com/en/", "x" * 50_000,
    ] * 2
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    listed = spark.createDataFrame([("bad.org/a",), ("bad.org/a",), (None,), ("other.org/b",)], "url_key string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == brute_url(u, {"bad.org/a", "other.org/b"}), u
    nothing = spark.createDataFrame([], "url_key string")
    assert url_filter.judge(pages, nothing).where("listed").count() == 0
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_bloom_passes_every_listed_url_and_few_others(spark):
    listed = spark.range(5000).selectExpr("concat('l', id) as url_key")
    bits, blocks = url_filter.bloom(listed)
    assert blocks == 2048 and bits.count() <= blocks
    both = spark.range(5000).selectExpr("concat('l', id) as url_key").unionByName(spark.range(20000).selectExpr("concat('n', id) as url_key"))
    assert url_filter.is_listed(both, listed).groupBy("listed").count().orderBy("listed").collect() == [(False, 20000), (True, 5000)]


def brute_shard(key: str, n: int) -> int:
    return max(range(n), key=lambda j: int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16))


def test_shards_match_plain_python(spark):
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts())] + [(5, "same")] * 40
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, size int")
    got = shards.assign(docs, rows_per_bucket=3).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots: dict[int, list[int]] = {}
    for r in got:
        name = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == brute_shard(name, 40) and r["grown_shard"] == brute_shard(name, 41)
        assert r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.assign(docs.limit(0)).count() == 0


def test_weights_shift_rows_in_proportion_and_growth_only_adds(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "'t' as text")
    got = shards.assign(docs, weights=[1.0, 1.0, 2.0], new_weight=2.0).toPandas()
    assert abs((got["shard"] == 2).mean() - 0.5) < 0.03
    moved = got[got["grown_shard"] != got["shard"]]
    assert (moved["grown_shard"] == 3).all() and abs(len(moved) / 6000 - 1 / 3) < 0.03
    with pytest.raises(ValueError):
        shards.assign(docs, weights=[1.0, 0.0])


def shingle_set(text):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_contained_items_are_found_and_only_they(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [say(30) for _ in range(12)] + [say(3), "", None, say(200)]
    docs = [None, "", items[12], "w1 w2"] + [say(n) for n in (5, 50, 4000)]
    for i in range(12):
        words = items[i].split()
        docs += [say(600) + " " + items[i].upper() + ". " + say(600), say(9) + " " + " ".join(words[: 10 + 2 * i % 22]) + " " + say(9)]
        words[i] = "changed"
        docs.append(", ".join(words) + say(40))
    docs += docs[6:9]
    doc_rows = spark.createDataFrame([(i, t, 0, "i", "x") for i, t in enumerate(docs)], "doc_id bigint, text string, h int, item_id string, text_key string")
    item_rows = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): r["shared"] for r in decontaminate.search(doc_rows.select("doc_id", "text"), item_rows).collect()}
    want = {}
    for d, t in enumerate(docs):
        for i, item in enumerate(items):
            own = shingle_set(item)
            if own and len(own & shingle_set(t)) >= 0.8 * len(own) - 1e-9:
                want[d, i] = len(own & shingle_set(t))
    assert got == want and len(want) >= 20
    clean = decontaminate.clean(doc_rows, item_rows)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in want}
    assert clean.columns == doc_rows.columns
    assert decontaminate.clean(doc_rows, item_rows.limit(0)).count() == len(docs)
    assert decontaminate.clean(doc_rows.limit(0), item_rows).count() == 0
