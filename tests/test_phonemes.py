"""The alphabets and maps against written pairs."""

from gatelab.functions import phonemes as P


def test_lengths():
    assert [len(x) for x in (P.IPA, P.SAMPA, P.CELEX, P.DISC, P.CGN)] == [81, 81, 81, 81, 80]
    assert all(len(v.split()) == 81 for v in P.EXAMPLES.values())
    assert len(P.AXIS) == len(set(P.AXIS)) == 38
    assert len(P.MAPS["response", "ipa"]) == 39 and len(P.MAPS["file", "ipa"]) == 40
    assert len(P.ARPABET) == 50 and len(P.BALDEY) == 40 and len(P.COOLEST) == 34


def test_collisions_and_exceptions():
    m = P.MAPS
    assert m["sampa", "ipa"]["w"] == m["celex", "ipa"]["w"] == m["disc", "ipa"]["w"] == "ʋ"
    assert m["celex", "ipa"]["Q"] == "ɒ" and m["celex", "ipa"]["U"] == "ʉ"
    assert m["celex", "ipa"]["l,r*"] == "l̩" and m["celex", "ipa"][""] == "*"
    assert '"' not in m["disc", "ipa"] and "ɒ̃ː" not in m["ipa", "disc"]
    assert m["ipa", "disc"]["oʊ"] == "5" and m["cgn", "ipa"]["J"] == "ɲ" and None not in m["cgn", "ipa"]
    assert m["ipa", "arpabet"]["h"] == "H" and m["ipa", "arpabet"]["n̩"] == "n" and m["ipa", "arpabet"]["m̩"] == "M"
    assert m["disc", "baldey"]["K"] == "E+" and m["disc", "baldey"]["M"] == "A+"
    assert m["coolest", "ipa"]["Y"] == "uː" and m["baldey", "ipa"]["Y"] == "ʉ"


def test_file_codes():
    m = P.MAPS
    pairs = {"I": "ih", "}": "uh", "@": "vh", "|": "eu", "K": "ei", "L": "ui", "M": "au", "N": "ng", "S": "sh", "Z": "zh", "_": "dj", "a": "a"}
    assert {k: m["disc", "file"][k] for k in pairs} == pairs
    assert m["file", "ipa"]["gx"] == "ɣ" and m["file", "ipa"]["dj"] == m["file", "ipa"]["-"] == "dʒ" and m["file", "ipa"]["vh"] == "ə"
