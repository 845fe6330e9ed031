"""Vietnamese syllables: parsing, normal form, a dense id and canonical spelling, as layered expressions."""

from __future__ import annotations

import unicodedata

# fixed values: names of the parts, in the order that ids are made of, and how they are written
INITIALS = "_none b c d q g h l m n p r s t v x ch gi kh ng nh ph th tr zd".split()
NUCLEI = "a e i o u y az aw ez oz ow uw oa oe oo uy ua uo iez oaw uaz uez uoz uow u_ow uyez ah oah".split()
FINALS = "_none i u m n ng c p t ch nh y o".split()
TONES = "_none s j f r x".split()
VOWELS = dict(zip("aăâeêioôơuưy", "a aw az e ez i o oz ow u uw y".split()))
PAIRS = {"iê": "iez", "ia": "iez", "oă": "oaw", "uă": "oaw", "uâ": "uaz", "uê": "uez", "uô": "uoz", "uơ": "u_ow", "ươ": "uow", "ưa": "uow", "uo": "uo", "ua": "ua", "ue": "ue", "ui": "ui"}
MARKS = {"s": "́", "j": "̣", "f": "̀", "r": "̉", "x": "̃"}
MAX_ID = len(INITIALS) * len(NUCLEI) * 42


def _alphabet() -> tuple[str, str, str]:
    """Letters in both cases, the toneless lower-case letter of each, and its tone as a digit."""
    letters = {c: (c, 0) for c in "abcdefghijklmnopqrstuvwxyzđ" + "".join(VOWELS)}
    for v in VOWELS:
        for tone, mark in MARKS.items():
            letters[unicodedata.normalize("NFC", v + mark)] = (v, TONES.index(tone))
    letters |= {c.upper(): x for c, x in letters.items()}
    keys = sorted(letters)
    return "".join(keys) + "0123456789", "".join(letters[k][0] for k in keys) + "?" * 10, "".join(str(letters[k][1]) for k in keys) + "?" * 10


FROM, BASE, TONE = _alphabet()


def _in(*names: str) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _case(col: str, table: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def _place(col: str, names: list[str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END"


def _name(col: str, names: list[str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


UPPER = "".join(c for c in FROM if c != c.lower())


def letters(col: str) -> dict[str, str]:
    return {"base": f"translate({col}, '{FROM}', '{BASE}')", "tones": f"translate({col}, '{FROM}', '{TONE}')"}


# fixed values: how initials are written
DIGRAPHS = {x: "q" if x == "qu" else x for x in "ch gh gi kh ng nh ph qu th tr".split()}
SINGLES = {x: "c" if x == "k" else x for x in "bcdghklmnprstvx"}
VOWEL = _in(*VOWELS)
STOPS = _in("c", "p", "t", "ch")
#: What each syllable matches, among other words: consonants, vowels (with the i of gi and a final vowel), a final.
SHAPE = "^[{}]{{0,3}}[{}]{{1,5}}([mMpPtT]|[nN][gGhH]?|[cC][hH]?)?$".format(*("".join(c for c, b in zip(FROM, BASE) if b != "?" and (b in VOWELS) == is_vowel) for is_vowel in (False, True)))


def parse(col: str = "token") -> list[dict[str, str]]:
    """Adds am_dau, am_giua, am_cuoi, tone (null where the token is no syllable) and can_be_vietnamese, in normal form."""
    at = lambda i: f"substr(base, pos + {i}, 1)"
    toned = lambda i: f"CASE WHEN substr(tones, pos + {i}, 1) IN ('1', '2', '3', '4', '5') THEN substr(tones, pos + {i}, 1) END"
    return [
        letters(col),
        {"n": "length(base)", "c0": "substr(base, 1, 1)", "c01": "substr(base, 1, 2)", "plain1": "substr(tones, 2, 1) = '0'", "fits": f"{{BYTES}}({col}) BETWEEN 1 AND 9 AND tones {{RX}} '^[0-5]+$'"},
        {"ini": f"CASE WHEN NOT fits THEN NULL WHEN c0 IN {VOWEL} THEN '_none' WHEN n < 2 THEN NULL WHEN c0 = 'đ' THEN 'zd' WHEN (plain1 OR c0 = 'q') AND c01 IN {_in(*DIGRAPHS)} THEN {_case('c01', DIGRAPHS)} ELSE {_case('c0', SINGLES)} END"},
        {
            "pos": f"CASE WHEN ini = '_none' THEN 1 WHEN ini = 'ng' AND substr(base, 3, 1) = 'h' THEN 4 WHEN ini IN {_in(*(x for x in DIGRAPHS if x != 'qu'))} THEN 3 ELSE 2 END",
            "gi_end": "ini = 'gi' AND n = 2", "gi_fin": f"ini = 'gi' AND substr(base, 3, 1) IN {_in(*'mncpt')}", "gi_long": f"{{BYTES}}(substr({col}, 3)) > 2",
        },
        {"x0": at(0), "x1": at(1), "x2": at(2), "t0": toned(0), "t1": toned(1), "t2": toned(2), "left_": "n - pos + 1"},
        {"y0": "CASE WHEN ini = '_none' AND x0 = 'y' AND x1 = 'ê' THEN 'i' ELSE x0 END"},
        {"two": "concat(y0, x1)"},
        {"glide": f"left_ >= 2 AND two IN {_in('uy', 'oa', 'oe', 'oo')}"},
        {
            "nuc": f"CASE WHEN ini IS NULL THEN NULL WHEN gi_end OR gi_fin THEN 'i' WHEN left_ < 1 OR x0 NOT IN {VOWEL} THEN NULL WHEN left_ = 1 THEN {_case('x0', VOWELS)} WHEN glide AND two = 'uy' AND x2 IN ('ê', 'a') THEN 'uyez' WHEN glide THEN two WHEN two IN {_in(*PAIRS)} THEN {_case('two', PAIRS)} ELSE {_case('y0', VOWELS)} END",
            "ton": "CASE WHEN gi_end OR gi_fin THEN NULL WHEN left_ = 1 THEN t0 WHEN glide THEN coalesce(t2, t1, t0) ELSE coalesce(t1, t0) END",
        },
        {"rest": f"CASE WHEN gi_end THEN '' WHEN gi_fin THEN substr(base, 3) WHEN left_ = 1 THEN '' WHEN nuc = 'uyez' THEN substr(base, pos + 3) WHEN glide OR two IN {_in(*PAIRS)} THEN substr(base, pos + 2) ELSE substr(base, pos + 1) END"},
        {"fin": f"CASE WHEN rest = '' THEN CASE WHEN nuc = 'ui' AND NOT glide AND left_ = 2 THEN 'i' ELSE '_none' END WHEN gi_fin AND gi_long THEN NULL WHEN rest IN {_in(*FINALS[1:])} THEN rest END", "nu2": "CASE WHEN nuc = 'ui' AND rest = '' THEN 'u' ELSE nuc END", "da2": "CASE WHEN gi_fin THEN 'g' ELSE ini END", "to2": "coalesce(" + _name("CAST(ton AS INT)", TONES) + ", '_none')"},
        {"ok1": f"da2 IS NOT NULL AND nu2 IS NOT NULL AND fin IS NOT NULL AND NOT (coalesce(fin, '') IN {STOPS} AND to2 NOT IN ('s', 'j'))"},
        {
            "ok2": f"ok1 AND NOT (da2 = 'gi' AND nu2 = 'i' AND fin <> '_none') AND NOT (nu2 IN ('ui', 'ue') AND da2 <> 'q') AND NOT (nu2 IN ('uy', 'uez', 'uaz', 'uyez') AND da2 = 'c') AND NOT (nu2 = 'uyez' AND fin IN {_in('ng', 'ch', 'nh')}) AND NOT (nu2 = 'iez' AND da2 = 'gi') AND NOT (da2 = 'q' AND nu2 = 'uoz' AND fin = '_none')",
            "to_c": "da2 = 'q' AND (nu2 IN ('ua', 'ue', 'ui') OR nu2 = 'u' AND fin = 'i')",
        },
        {
            "can_be_vietnamese": "coalesce(ok2, false)",
            "am_dau": "CASE WHEN ok2 THEN CASE WHEN to_c THEN 'c' WHEN da2 = 'gh' THEN 'g' WHEN da2 = 'g' AND nu2 = 'i' AND fin = '_none' THEN 'gi' ELSE da2 END END",
            "am_giua": "CASE WHEN ok2 THEN CASE WHEN to_c THEN CASE nu2 WHEN 'ua' THEN 'oa' WHEN 'ue' THEN 'oe' ELSE 'uy' END WHEN da2 = 'gi' AND nu2 = 'ez' AND fin <> '_none' THEN 'iez' ELSE nu2 END END",
            "am_cuoi": "CASE WHEN ok2 THEN CASE WHEN to_c AND nu2 = 'u' THEN '_none' ELSE fin END END",
            "tone": "CASE WHEN ok2 THEN to2 END",
        },
    ]


ENCODE = [
    {
        "fold_cuoi": "CASE am_cuoi WHEN 'y' THEN 'i' WHEN 'o' THEN 'u' WHEN 'nh' THEN 'ng' WHEN 'ch' THEN 'c' ELSE am_cuoi END",
        "fold_giua": "CASE WHEN am_cuoi IN ('y', 'o') AND am_giua = 'a' THEN 'aw' WHEN am_cuoi IN ('y', 'o') AND am_giua = 'oa' THEN 'oaw' WHEN am_cuoi IN ('nh', 'ch') AND am_giua = 'a' THEN 'ah' WHEN am_cuoi IN ('nh', 'ch') AND am_giua = 'oa' THEN 'oah' ELSE am_giua END",
    },
    {"i0": _place("am_dau", INITIALS), "i1": _place("fold_giua", NUCLEI), "i2": _place("fold_cuoi", FINALS), "i3": _place("tone", TONES)},
    {"syll_id": "CAST(i0 * 1176 + i1 * 42 + CASE WHEN i2 < 6 THEN i2 * 6 + i3 ELSE 36 + (i2 - 6) * 2 + i3 - 1 END AS BIGINT)"},
]
DECODE = [
    {"d0": "CAST(syll_id {DIV} 1176 AS INT)", "d1": "CAST((syll_id {DIV} 42) % 28 AS INT)", "d2": "CAST(syll_id % 42 AS INT)"},
    {"am_dau": _name("d0", INITIALS), "raw_giua": _name("d1", NUCLEI), "raw_cuoi": _name("CASE WHEN d2 < 36 THEN CAST(d2 {DIV} 6 AS INT) ELSE CAST((d2 - 36) {DIV} 2 AS INT) + 6 END", FINALS), "tone": _name("CASE WHEN d2 < 36 THEN d2 % 6 ELSE (d2 - 36) % 2 + 1 END", TONES)},
    {
        "am_giua": "CASE WHEN raw_cuoi IN ('i', 'u') AND raw_giua = 'aw' THEN 'a' WHEN raw_cuoi IN ('i', 'u') AND raw_giua = 'oaw' THEN 'oa' WHEN raw_cuoi IN ('ng', 'c') AND raw_giua = 'ah' THEN 'a' WHEN raw_cuoi IN ('ng', 'c') AND raw_giua = 'oah' THEN 'oa' ELSE raw_giua END",
        "am_cuoi": "CASE WHEN raw_cuoi = 'i' AND raw_giua IN ('aw', 'oaw', 'az', 'uaz') THEN 'y' WHEN raw_cuoi = 'u' AND raw_giua IN ('aw', 'oaw', 'e', 'oe') THEN 'o' WHEN raw_cuoi = 'ng' AND raw_giua IN ('ez', 'i', 'uez', 'uy', 'ah', 'oah') THEN 'nh' WHEN raw_cuoi = 'c' AND raw_giua IN ('ez', 'i', 'uez', 'uy', 'ah', 'oah') THEN 'ch' ELSE raw_cuoi END",
    },
]
#: Parts that can't be enumerated: helper nuclei, and uoz without a final.
INVALID = "am_giua IN ('ah', 'oah') OR am_giua = 'uoz' AND am_cuoi = '_none'"
#: Parts as they are decoded -> n_dau, n_giua, n_cuoi in normal form, as parsing gives it; sounds: whether they can be a syllable.
NORMAL = [
    {
        "sounds": f"NOT (am_dau = 'gi' AND (am_giua = 'iez' OR am_giua = 'i' AND am_cuoi <> '_none')) AND NOT (am_giua IN ('ui', 'ue') AND am_dau <> 'q') AND NOT (am_giua IN ('uy', 'uez', 'uaz', 'uyez') AND am_dau = 'c') AND NOT (am_giua = 'uyez' AND am_cuoi IN {_in('ng', 'ch', 'nh')}) AND NOT ({INVALID})",
        "as_c": "am_dau = 'q' AND (am_giua IN ('ua', 'ue', 'ui') OR am_giua = 'u' AND am_cuoi = 'i')",
    },
    {
        "n_dau": "CASE WHEN as_c THEN 'c' WHEN am_dau = 'g' AND am_giua = 'i' AND am_cuoi = '_none' THEN 'gi' ELSE am_dau END",
        "n_giua": "CASE WHEN as_c THEN CASE am_giua WHEN 'ua' THEN 'oa' WHEN 'ue' THEN 'oe' ELSE 'uy' END WHEN am_dau = 'gi' AND am_giua = 'ez' AND am_cuoi <> '_none' THEN 'iez' ELSE am_giua END",
        "n_cuoi": "CASE WHEN as_c AND am_giua = 'u' THEN '_none' ELSE am_cuoi END",
    },
]
EI_Y = "substr(am_giua, 1, 1) IN ('e', 'i', 'y')"
TONED = "".join(unicodedata.normalize("NFC", v + m) for m in MARKS.values() for v in VOWELS)
SPELL = [
    {
        "head": f"CASE WHEN am_dau = '_none' THEN '' WHEN am_dau = 'zd' THEN 'đ' WHEN am_dau = 'c' AND {EI_Y} THEN 'k' WHEN am_dau = 'c' AND am_giua IN ('uyez', 'oa', 'oe', 'uy', 'uez', 'uaz') THEN 'q' WHEN am_dau = 'gi' AND substr(am_giua, 1, 1) = 'i' THEN 'g' WHEN am_dau IN ('g', 'ng') AND {EI_Y} THEN concat(am_dau, 'h') ELSE am_dau END",
        "body": "CASE am_giua WHEN 'az' THEN 'â' WHEN 'aw' THEN 'ă' WHEN 'ez' THEN 'ê' WHEN 'oz' THEN 'ô' WHEN 'ow' THEN 'ơ' WHEN 'uw' THEN 'ư' WHEN 'u_ow' THEN 'uơ' WHEN 'uaz' THEN 'uâ' WHEN 'uez' THEN 'uê' WHEN 'oaw' THEN CASE WHEN am_dau = 'q' THEN 'uă' ELSE 'oă' END WHEN 'oa' THEN CASE WHEN am_dau = 'c' THEN 'ua' ELSE 'oa' END WHEN 'oe' THEN CASE WHEN am_dau = 'c' THEN 'ue' ELSE 'oe' END WHEN 'uoz' THEN CASE WHEN am_cuoi = '_none' THEN 'ua' ELSE 'uô' END WHEN 'uow' THEN CASE WHEN am_cuoi = '_none' THEN 'ưa' ELSE 'ươ' END WHEN 'iez' THEN CASE WHEN am_cuoi = '_none' THEN 'ia' WHEN am_dau = '_none' THEN 'yê' ELSE 'iê' END WHEN 'uyez' THEN CASE WHEN am_cuoi = '_none' THEN 'uya' ELSE 'uyê' END ELSE am_giua END",
    },
    {"mark_at": "CASE WHEN tone = '_none' OR am_giua IN ('ue', 'ui', 'ah', 'oah') THEN 0 WHEN am_giua = 'ua' OR am_cuoi = '_none' AND (am_giua IN ('iez', 'uow') OR am_giua = 'uoz' AND am_dau <> 'q') THEN 1 WHEN am_giua = 'uyez' AND am_cuoi = '_none' THEN 2 ELSE length(body) END"},
    {"bare": "substr(body, mark_at, 1)"},
    {"marked": "CASE WHEN mark_at = 0 THEN body ELSE concat(substr(body, 1, mark_at - 1), CASE tone " + " ".join(f"WHEN '{t}' THEN translate(bare, '{''.join(VOWELS)}', '{TONED[12 * i:12 * i + 12]}')" for i, t in enumerate(MARKS)) + " ELSE bare END, substr(body, mark_at + 1)) END"},
    {"text": "concat(head, marked, CASE WHEN am_cuoi = '_none' THEN '' ELSE am_cuoi END)"},
]
# the part lists below are fixed values too
FEATURES = {
    "len_dau": f"CASE WHEN am_dau = '_none' THEN 0 WHEN am_dau IN {_in('ch', 'gi', 'kh', 'ng', 'nh', 'ph', 'th', 'tr', 'zd')} THEN 2 ELSE 1 END",
    "len_giua": f"CASE WHEN am_giua IN {_in('a', 'e', 'i', 'o', 'u', 'y', 'az', 'aw', 'ez', 'oz', 'ow', 'uw')} THEN 1 WHEN am_giua = 'uyez' THEN 3 ELSE 2 END",
    "len_cuoi": f"CASE WHEN am_cuoi = '_none' THEN 0 WHEN am_cuoi IN {_in('ng', 'ch', 'nh')} THEN 2 ELSE 1 END",
    "len_tone": "CASE WHEN tone = '_none' THEN 0 ELSE 1 END",
    "no_mark": "CASE WHEN am_dau = 'zd' THEN 'd' ELSE am_dau END",
    "has_tone": "tone <> '_none'",
    "has_mark": f"am_dau = 'zd' OR am_giua IN {_in('az', 'aw', 'ez', 'oz', 'ow', 'uw', 'iez', 'oaw', 'uaz', 'uez', 'uoz', 'uow', 'u_ow', 'uyez')}",
    "is_stop": f"am_cuoi IN {STOPS}",
    "tone_is_stop": "tone IN ('s', 'j')",
    "can_be_stop": "tone IN ('s', 'j', '_none')",
    "is_harsh": "tone IN ('x', 'j')",
    "start_with_iy": "am_giua IN ('i', 'y', 'iez')",
    "has_am_dem": f"am_dau = 'q' OR am_giua IN {_in('oa', 'oe', 'oo', 'uy', 'oaw', 'uaz', 'uez', 'uyez')}",
    "final_consonant_start": f"substr(am_cuoi, 1, 1) IN {_in(*'mncpt')}",
    "full_dau": f"am_dau NOT IN {_in('_none', 'c', 'd', 'g', 'n', 'p', 't', 'ng')}",
}
#: Of those before: the length of the whole, and whether each part can be followed by more of its own.
WHOLE = {
    "len_all": "len_dau + len_giua + len_cuoi + len_tone",
    "has_mark_or_tone": "has_mark OR has_tone",
    "full_giua": f"len_giua > 1 AND am_giua NOT IN {_in('oa', 'oo', 'ua', 'uy')}",
    "full_cuoi": "am_cuoi NOT IN ('_none', 'c', 'n')",
    "full_tone": "has_tone",
    "full_all": "am_cuoi NOT IN ('_none', 'c', 'n') AND has_tone",
}
