"""Phoneme alphabets and the maps between them, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelab.functions.text import literal_table

# --- fixed values ------------------------------------------------------------------

#: The phoneme classes of the experiment, by DISC symbol: vowels, then consonants.
VOWELS = "I E A O } @ i a u y e | o K L M".split()
CONSONANTS = "p b t d k g N m n l r f v s z S Z j x h w _".split()

#: One symbol per phoneme and alphabet; position k of every list is the same phoneme.
IPA = (
    "p b t d k g ŋ m n l r f v θ ð s z ʃ ʒ j x ɣ h w ʋ pf ts tʃ dʒ ŋ̩ m̩ n̩ l̩ * iː iːː ɑː aː ɔː uː ɜː yː yːː ɛː œː ɒː eː øː oː "
    "eɪ ɑɪ ɔɪ əʊ aʊ ɪə ɛə ʊə ɛi œy ɑu ai au ɔy ɪ ʏ ɛ œ æ a ɑ ɒ ʌ ɔ ʊ ʉ ə œ̃ æ̃ ɑ̃ː æ̃ː ɒ̃ː"
).split()
SAMPA = (
    "p b t d k g N m n l r f v T D s z S Z j x G h w w pf ts tS dZ N, m, n, l, r* i: i:: A: a: O: u: 3: y: y:: E: /: Q: e: |: o: "
    'eI aI OI @U aU I@ E@ U@ EI /I Au ai au Oy I Y E / { a A Q V O U } @ /" {" A": {": O":'
).split()
#: The 33rd symbol is "l,r*" and the 34th is empty.
CELEX = (
    "p b t d k g N m n l r f v T D s z S Z j x G h w w pf ts tS dZ N, m, n, l,r*".split()
    + [""]
    + 'i: i:: A: a: O: u: 3: y: y:: E: U: Q: e: &: o: eI aI OI @U aU I@ E@ U@ EI UI AU ai au Oy I Y E Q & a A Q V O U U @ Q" &" A": &": O":'.split()
)
DISC = "p b t d k g N m n l r f v T D s z S Z j x G h w w + = J _ C F H P R i ! # a $ u 3 y ( ) * < e | o 1 2 4 5 6 7 8 9 K L M W B X I Y E / { & A Q V O U } @ ^ c q 0 \"".split()
#: None: no symbol; one phoneme shorter than the others.
CGN = [
    None if x == "None" else x
    for x in (
        "p b t d k g N m n l r f v None None s z S Z j x G h None w None None None None None None None None None i None None a None u None y None "
        "E: Y: O: e 2 o None None None None None None None None E+ Y+ A+ None None None I None E None None None A None None O None Y @ Y~ A~ E~ O~"
    ).split()
]

EXAMPLES = {
    "nl": (
        "put bad tak dak kat goal lang mat nat lat rat/later fiets vat None None sap zat sjaal ravage jas light/gaat regen had None wat None None None jazz None "
        "None None None None liep analyse None laat None boek None buut centrifuge scene freule zone leeg deuk boom None None None None None None None None "
        "wijs huis koud None None None lip None leg None None None lat None None bom None put gelijk None None None None None"
    ),
    "en": (
        "pat bad tack dad cad game bang mad nat lad rat fat vat thin then sap zap sheep measure yank loch None had why None None None cheap jeep bacon idealism "
        "burden dangle father bean None barn None born boon burn None None None None None None None None bay buy boy no brow peer pair poor None None None None "
        "None None pit None pet None pat None None pot putt None put None another None timbre detente lingerie bouillon"
    ),
    "de": (
        "Pakt Bad Tag dann kalt Gast Klang maß naht Last Ratte falsh Welt None None Gas Suppe Schiff Genie Jack Bach/ich None Hand waterproof None Pferd Zahl "
        "Matsch Gin None None None None None Lied None Advantage klar Allroundman Hut Teamwork für None Käse None None Mehl Möbel Boot Native Shylock Playboy "
        "None Allroundsportler None None None None None None weit Haut freut Mitte Pfütze Bett Götter Ragtime hat Kalevala None Plumpudding Glocke Pult None "
        "Beginn Parfum impromptu Détente lingerie bouillon"
    ),
}

#: ARPAbet code, IPA symbol, example.
ARPABET = [
    line.split()
    for line in """
AA ɑ b(al)m,b(o)t
AE æ b(a)t
AH ʌ b(u)tt
AO ɔ c(augh)t,st(o)ry
AW aʊ b(ou)t
AX ə comm(a)
AY ai b(i)te
EH ɛ b(e)t
ER ɝ b(ir)d,forew(or)d
EY eɪ b(ai)t
IH ɪ b(i)t
IX ɨ ros(e)s,rabb(i)t
IY i b(ea)t
OW oʊ b(oa)t
OY ɔɪ b(oy)
UH ʊ b(oo)k
UW u b(oo)t
UX ʉ d(u)de
B b (b)uy
CH tʃ (Ch)ina
D d (d)ie
DH ð (th)y
DX ɾ bu(tt)er
EL l̩ bott(le)
EM m̩ ryth(m)
EN n̩ butt(on)
F f (f)ight
G g (g)uy
HH h (h)igh
H h (h)igh
JH dʒ (j)ive
K k (k)ite
L l (l)ie
M m (m)y
N n (n)igh
NX ɾ̃ wi(nn)er
NG ŋ si(ng)
P p (p)
Q ʔ uh(-)oh
R ɹ (r)ye
S s (s)igh
SH ʃ (sh)y
T t (t)ie
TH θ (th)igh
V v (v)ie
W w (w)ise
WH ʍ (wh)y
Y j (y)acht
Z z (z)oo
ZH ʒ plea(s)ure
""".strip().splitlines()
]
#: IPA symbols that are written with an ARPAbet code that isn't theirs.
ARPABET_FROM_IPA = {
    "n̩": "n", "r": "R", "x": "X", "ɜː": "ER", "ɑɹ": "R", "ɚ": "AX", "əʊ": "UH", "ɪə": "IH",
    "ɛə": "EH", "ʊə": "UH", "æ̃": "AE", "ɔ̃": "AO", "m̩": "M", "ɑː": "AA", "ɔː": "AO",
}
#: IPA symbols as ARPAbet's list spells them.
ARPABET_SPELLING = {"*": "r", "iː": "i", "uː": "u", "ɑɪ": "ai", "ɑ̃ː": "ɑː", "ɒ": "ɔ", "ɔ̃": "ɔ", "æ̃ː": "æ̃", "ŋ̩": "ŋ"}

BALDEY = "n Y m @ r s b E k f A t y p i x O Y+ j v u l I z E+ G w d h o e g a N Au Ei S T A+ Z".split()
BALDEY_TO_IPA = {
    "y": "yː", "i": "iː", "Y+": "œy", "u": "uː", "Ei": "ɛi", "E+": "ɛi", "A+": "ɑu",
    "a": "aː", "e": "eː", "Y": "ʉ", "o": "oː", "2": "øː", "w": "ʋ",
}
COOLEST = "o: u b g Au i z f v G x n E Ei @ y O 9y A e: I t Y l k a: w d N r s h p m".split()
COOLEST_TO_IPA = {"u": "uː", "Y": "uː", "y": "yː", "i": "iː", "Ei": "ɛi", "9y": "œy", "w": "ʋ"}
COOLEST_VOWELS = "o: u Au i E Ei @ y O 9y A e: I a: Y".split()
COOLEST_CONSONANTS = "b g z f v G x n t l k w d N r s h p m".split()
CELEX_DUTCH = "a x j @ t A p l s d n I N k b E Z K m e v r L G f O w u z i } h o y M | S g * ) ! < _ (".split()

#: How symbols are spelled in the names of label files, where that isn't the symbol.
FILE_CODE = {
    "I": "ih", "E": "eh", "A": "ah", "O": "oh", "}": "uh", "@": "vh", "|": "eu", "K": "ei", "L": "ui", "M": "au", "N": "ng", "S": "sh", "Z": "zh", "_": "dj",
}
FILE_CODE_BESIDES = {"gx": "ɣ"}
NO_SOUND = "-"

#: Stress and position codes of the second sound, spelling as in the study.
CODINGS = {
    "0": "unstresssed",
    "1": "stressed",
    "2": "syllable boundary in diphone, stress on second phoneme",
    "3": "syllable boundary in diphone, stress on first phoneme",
    "s": "segment contains two strong vowels both stressed",
    "w": "segment contains two weak vowels both stressed",
    "b": "leading environment",
}

# --- maps, by rule ------------------------------------------------------------------

SETS = {"ipa": IPA, "sampa": SAMPA, "celex": CELEX, "disc": DISC, "cgn": CGN}
#: The pairs of alphabets that have a map.
CORE = [
    ("ipa", "sampa"), ("ipa", "celex"), ("ipa", "disc"), ("ipa", "cgn"), ("sampa", "ipa"), ("sampa", "celex"), ("sampa", "disc"), ("celex", "ipa"),
    ("celex", "sampa"), ("celex", "disc"), ("disc", "ipa"), ("disc", "sampa"), ("disc", "celex"), ("disc", "cgn"), ("cgn", "ipa"), ("cgn", "disc"),
]


def core_map(src: str, dst: str) -> dict[str, str]:
    """By position, as far as the shortest list goes; of equal source symbols the last counts."""
    out = {a: b for a, b, _ in zip(SETS[src], SETS[dst], CGN) if a is not None}
    if (src, dst) == ("ipa", "disc"):
        out["oʊ"] = "5"
    if (src, dst) == ("cgn", "ipa"):
        out["J"] = "ɲ"
    return out


def _through_ipa(chosen: dict[str, str]) -> dict[str, str]:
    disc = core_map("ipa", "disc")
    return {code: disc[ipa] for code, ipa in chosen.items()}


def _subset(names: list[str], own: dict[str, str]) -> dict[str, str]:
    known = core_map("sampa", "ipa")
    return {k: v for k, v in known.items() if k in set(names)} | own


def typed_symbols(ipa_of: dict[str, str]) -> list[tuple[str, str, str]]:
    """What a listener can type: (symbol, IPA, code in file names), the mark for no sound last."""
    sounds = [(d, ipa_of[d], FILE_CODE.get(d, d)) for d in VOWELS + CONSONANTS]
    return [*sounds, (NO_SOUND, ipa_of["_"], NO_SOUND)]


def all_maps() -> dict[tuple[str, str], dict[str, str]]:
    """(source alphabet, target alphabet) → symbols."""
    out = {p: core_map(*p) for p in CORE}
    out["arpabet", "ipa"] = {a: i for a, i, _ in ARPABET}
    out["ipa", "arpabet"] = {i: a for a, i, _ in ARPABET} | ARPABET_FROM_IPA
    spelled = [(ARPABET_SPELLING.get(i, i), d) for i, d in out["ipa", "disc"].items()]
    both = [(out["ipa", "arpabet"][i], d) for i, d in spelled if i in out["ipa", "arpabet"]]
    out["arpabet", "disc"], out["disc", "arpabet"] = dict(both), {d: a for a, d in both}
    out["baldey", "ipa"] = _subset(BALDEY, BALDEY_TO_IPA)
    out["baldey", "disc"] = _through_ipa(out["baldey", "ipa"])
    out["disc", "baldey"] = {d: b for b, d in out["baldey", "disc"].items()}
    out["ipa", "baldey"] = {i: b for b, i in out["baldey", "ipa"].items()}
    out["coolest", "ipa"] = _subset(COOLEST, COOLEST_TO_IPA)
    typed = typed_symbols(out["disc", "ipa"])
    out["response", "ipa"] = {symbol: ipa for symbol, ipa, _ in typed}
    out["file", "ipa"] = {code: ipa for _, ipa, code in typed} | FILE_CODE_BESIDES
    out["disc", "file"] = {symbol: code for symbol, _, code in typed if symbol != NO_SOUND}
    return out


MAPS = all_maps()
AXIS = [MAPS["disc", "ipa"][d] for d in VOWELS + CONSONANTS]


# --- as columns and tables ------------------------------------------------------------


def lookup(symbol: Column, src: str, dst: str) -> Column:
    """The symbol in another alphabet; NULL where it has none."""
    pairs = [F.lit(x) for k, v in MAPS[src, dst].items() if v is not None for x in (k, v)]
    return F.element_at(F.create_map(*pairs), symbol)


def code_map(spark: SparkSession) -> DataFrame:
    rows = [(s, k, d, v) for (s, d), m in MAPS.items() for k, v in m.items()]
    return literal_table(spark, rows, dict.fromkeys(("src_set", "src", "dst_set", "dst"), "string"))


def transcode(df: DataFrame, column: str, src: str, dst: str, out: str) -> DataFrame:
    return df.withColumn(out, lookup(F.col(column), src, dst))


def dim_phoneme(spark: SparkSession) -> DataFrame:
    words = {k: [None if x == "None" else x for x in v.split()] for k, v in EXAMPLES.items()}
    get = lambda xs, k: xs[k] if k < len(xs) else None
    rows = [(k, IPA[k], SAMPA[k], CELEX[k], DISC[k], get(CGN, k), *(get(words[w], k) for w in ("nl", "en", "de"))) for k in range(len(IPA))]
    return literal_table(spark, rows, {"ord": "int"} | dict.fromkeys(("ipa", "sampa", "celex", "disc", "cgn", "example_nl", "example_en", "example_de"), "string"))


def dim_coding(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(CODINGS.items()), {"code": "string", "label": "string"})


def dim_axis(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(enumerate(AXIS)), {"ord": "int", "ipa": "string"})
