"""Inputs on which the text operators once lost text, hung, overflowed or needed memory by the number of rows."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from usage_ts.llm import embedding_dedup, html_extract, language_id, packing, url_tree

BODY = [f"Paragraph {k} of the story tells how the river rose over the old bridge and what the town did next." for k in range(6)]


def page(inner):
    return f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>The river</h1>{inner}</article></body></html>"


ODD = ['<svg class="i"/>', "<svg>", "<button>", "<select><option>", "<button class=x/>", "<svg><title>t</title></svg>"]
PAGES = {odd: page("".join(f"<p>{t}{odd if k == 1 else ''}</p>" for k, t in enumerate(BODY))) for odd in ODD}
PAGES |= {tag: page(f"<{tag}>" + "".join(f"<p>{t}</p>" for t in BODY) + f"</{tag}>") for tag in ("object", "noscript")}
WITHIN = "".join(f"<p>{t} <button>Copy</button><svg><path d='m'/></svg> End.</p>" for t in BODY)


@pytest.fixture(scope="module")
def extracted(spark):
    pages = {**PAGES, "within": page(WITHIN)}
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages.items())], "page_id long, url string, html string")
    return {r["url"]: r["text"] for r in html_extract.extract(df).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_controls_drawings_and_containers_swallow_no_paragraph(extracted, name):
    assert all(t in extracted[name] for t in BODY)


def test_button_within_a_paragraph_leaves_it_whole(extracted):
    assert extracted["within"].count(" next. End.") == len(BODY)


@pytest.mark.parametrize("html", ["<b>{n}</i>{n}", "<b>{n}<p>x{n}", "<div>{n}<dt>x</dt>{n}", "<i><div><b>{n}</i>{n}", "<svg>{n}", "<button>{n}x"])
def test_parsing_takes_time_in_proportion(html):
    head, *rest = html.split("{n}")
    text = head * 60_000 + "".join(r * 60_000 for r in rest)
    start = time.process_time()
    html_extract.parse(text)
    assert time.process_time() - start < 8


def test_vectors_of_any_size_are_compared(spark):
    rows = [(i, 1, [x] * 4) for i, x in enumerate((1e200, 1e-200, 5e-324, 1e308, 3.0))] + [(5, 1, [1e200, -1e200, 0.0, 0.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {**dict.fromkeys(range(5), (4, 0)), 5: (0, 5)}


def test_many_tiny_items_take_little_memory():
    tracemalloc.start()
    at = packing.windows_for([2] * 400_000, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.bincount(at, minlength=at.max() + 1).max() * 2 <= 4096 and at.max() + 1 == 196
    assert peak < 200e6


def test_small_and_large_items_fill_windows():
    rng = random.Random(8)
    sizes = [rng.choice([rng.randint(1, 63), rng.randint(64, 4096)]) for _ in range(900)]
    at = packing.windows_for(sizes, 4096)
    sums = np.bincount(at, weights=sizes)
    assert sums.max() <= 4096 and len(sums) <= 1.03 * -(-sum(sizes) // 4096)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_language_with_one_document_is_learned(spark):
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    rows = [(" ".join(word("abcdefgh") for _ in range(80)), "aa") for _ in range(60)]
    lone = " ".join(word("дежзиклмн") for _ in range(80))
    docs = docs_of(spark, rows + [(lone, "bb")] * 3)
    got = [r for r in language_id.identify(docs).collect() if r["doc_id"] >= 60]
    assert {r["lang_pred"] for r in got} == {"bb"} and all(r["score"] > 0.9 for r in got)
    assert language_id.accepted(docs, language_id.learn(docs)).count() == len(rows) + 3


def test_script_with_many_groups_is_accepted(spark):
    """Two thousand letters: hardly any group of four recurs, and far more than 20,000 are needed."""
    rng = random.Random(10)
    words = ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(2)) for _ in range(30_000)]
    wide = [("。".join(rng.choice(words) for _ in range(400)), "zz") for _ in range(150)]
    plain = [(" ".join(rng.choice(("one", "two", "three", "four")) for _ in range(60)), "aa") for _ in range(60)]
    docs = docs_of(spark, wide + plain)
    filters = language_id.learn(docs)
    assert len(filters.names) == 2 and language_id.accepted(docs, filters).count() == len(wide) + len(plain)


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r["path"]: (r["template"], r["blocked_share"]) for r in url_tree.judge(pages, rules).collect()}


def test_small_blocked_section_stays_apart(spark):
    """One of 25 even sections is blocked as a whole."""
    urls = [f"http://a.org/s{k}/p{i}" for k in range(25) for i in range(20)]
    got = judged(spark, urls, (("allow", "org/"), ("block", "a.org/s7/")))
    assert all(share > 0.5 for path, (_, share) in got.items() if path.startswith("/s7/"))
    assert all(share < 0.5 for path, (_, share) in got.items() if not path.startswith("/s7/"))


def test_deep_sections_are_divided(spark):
    """What decides is the seventh segment."""
    urls = [f"http://a.org/u{i % 5}/v{i % 3}/w/x/y/z/{kind}/p{i}" for i in range(60) for kind in ("good", "bad")]
    rules = (("allow", "org/"), *(("block", f"a.org/u{a}/v{b}/w/x/y/z/bad/") for a in range(5) for b in range(3)))
    got = judged(spark, urls, rules)
    assert {t for t, _ in got.values()} == {"/*/*/*/*/*/*/good", "/*/*/*/*/*/*/bad"}
    assert all((share > 0.5) == ("/bad/" in path) for path, (_, share) in got.items())
