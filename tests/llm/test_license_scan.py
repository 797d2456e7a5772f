import re

from docrisk.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in ls.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


CASES = [
    None, "", " \n", "MIT License", "mit-license; MIT\nLICENSE mit license", "the GNU  General-Public license, cc by cc BY 4.0",
    "xmit license mit licenses", "Émit license", "apache licensé apache license", "İİ MIT licenſe mit\x00license", "word " * 9000 + "cc by",
    "퟿ cc by cc by", "MIT_License MIT`License mit{license 9mit license",
]


def test_base_counts_against_brute_force(spark, docs_of):
    rows = ls.scan(docs_of(list(enumerate(CASES)))).collect()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(CASES[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_notices_with_edits():
    m = ls.notice_matchers()
    text = "x " * 50 + "relaesed under the mit licence" + " y" * 50
    (label, a, b, edits, score), *_ = ls.find_notices(text, m)
    assert label == "mit" and 0 < edits <= 3 and 0.8 < score < 1 and "under the mit" in text[a:b]
    assert ls.find_notices("nothing to see here, rights deserved", m) == []


def test_pigeonhole_loses_nothing():
    """Every window within the edit bound is found, against matching without seeds."""
    import random

    import regex

    rng = random.Random(3)
    for notice, label, k in ls.NOTICES:
        whole = regex.compile(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}")
        for _ in range(20):
            chars = list(notice)
            for _ in range(rng.randint(0, k + 2)):
                at, kind = rng.randrange(len(chars)), rng.randrange(3)
                chars[at : at + 1] = [[], ["q"], [chars[at], "q"]][kind]
            text = "zz " * 5 + "".join(chars) + " zz" * 5
            found = any(s[0] == label for s in ls.find_notices(text, ls.notice_matchers(((notice, label, k),))))
            assert found == bool(whole.search(text))


def test_places_before_the_best_one_and_wrapped_headers():
    m, bases = ls.notice_matchers(), ls.base_matchers(ls.BASE)
    spans = lambda t: [s for s in ls.scan_text(t, bases, m)[-1] if s[0] in ("mit", "mpl")]
    text = "relaesed under the mit license released under the mit license"
    assert len(spans(text)) == 2
    assert len(spans(" ".join([text] * 3))) == 6
    header = "/* subject to the terms of the Mozilla Public\n * License, v. 2.0\n\n#  Released   under\n# the MIT\r\n#\tLicense. */"
    (_, a, b, _), (_, c, d, _) = spans(header)
    assert header[a:b] == "Mozilla Public\n * License" and header[c:d] == "Released   under\n# the MIT\r\n#\tLicense"


def test_empty_table(spark, docs_of):
    assert ls.scan(docs_of([(1, "a")]).limit(0)).count() == 0
