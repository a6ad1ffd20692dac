"""Operators that do the whole job where they once stopped short."""

import numpy as np
import pytest

from laddersmith.llm import html_text, license_scan, quality


def test_every_notice_of_a_long_list_is_found(spark):
    filler = " and these words stand between the notices of one file and the next "
    every = filler.join(t for _, t, _ in license_scan.TEMPLATES)
    plain = "Plain text about licences and the public."
    rows = [(1, every), *[(i, plain) for i in range(2, 40)], (40, license_scan.TEMPLATES[0][1])]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[1].labels.split(",")) == {label for label, _, _ in license_scan.TEMPLATES}
    assert got[40].labels == "mit" and got[2].labels == "" and got[1].score == 1.0


def test_a_notice_with_an_insertion_keeps_its_best_alignment():
    x = license_scan.Index({"restriction": 9.0})
    t = license_scan.TEMPLATES[0][1].split()
    at = t.index("without")
    number = {w: i for i, w in enumerate(x.words)}
    file = np.array([number.get(w, -1) for w in [*t[:at], "any", "such", *t[at:]]])
    labels, share = x.scan(file)
    assert labels == {"mit"} and share >= at / len(t)


TEXT = [f"{n} paragraph of the text, " + "with many words and some commas, " * 12 for n in "one two three four five six".split()]
SECTIONS = "".join("<section>" + "".join(f"<p>{n} {x}</p>" for x in TEXT[:5]) + "</section>" for n in ("first", "second", "third"))


@pytest.mark.parametrize("page", ["<body><div class=content>%s</div></body>", "<body><div id=top><a href=1>one</a><a href=2>two</a></div><div class=content><h2>T</h2>%s</div></body>"])
def test_pages_without_article_keep_all_sections(page):
    got = html_text.extract(page % SECTIONS)
    assert all(f"{n} {x.strip()}" in got for n in ("first", "second", "third") for x in TEXT[:5])
    assert "onetwo" not in got


def test_every_article_of_a_page_is_kept():
    page = "<body><div id=list>" + "".join(f"<article><h2>T{n}</h2><p>{n} {TEXT[0]}</p><p>{n} {TEXT[1]}</p></article>" for n in (1, 2, 3)) + "</div><ul><li><a href=1>x</a></ul></body>"
    got = html_text.extract(page)
    assert all(f"{n} {x.strip()}" in got for n in (1, 2, 3) for x in TEXT[:2])


def test_a_small_language_is_not_judged_by_the_others(spark):
    import public_tokenizers

    word = "people water house small garden morning letter winter summer street river window table paper".split()
    rows = [(i, " ".join(word[(i * 3 + k * (1 + i % 5)) % len(word)] + ("s" if (i + k) % 3 else "") + " x" * (k % 2) for k in range(120)), "en") for i in range(60)]
    small = "ᚠᚢᚦᚨᚱᚲᚷᚹᚺᚾᛁᛃᛇᛈᛉᛊᛏᛒᛖᛗᛚᛜᛞᛟ"
    rows += [(100 + i, " ".join(small[k % 20 : k % 20 + 3] + small[(k * 7 + i) % 24] + small[(k * 5) % 23] for k in range(120)), "rn") for i in range(quality.FEW - 1)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(public_tokenizers.path("piece_bpe_32k.model"))).collect()
    own = [r for r in got if r.doc_id >= 100 and not r.base_failed]
    assert own and all(r.kept for r in own)
