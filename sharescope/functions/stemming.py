"""Word stems in English and Spanish, for the distinct vocabulary of an index.

The two published Snowball algorithms on folded (unaccented) words, driven by suffix tables.
They run inside an Arrow UDF over distinct words only; texts themselves are never stemmed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words each language's index leaves out (forms with accents never occur after folding).
ENGLISH_STOP = set("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now
""".split())
SPANISH_STOP_WORDS = """
de la que el en y a los del se las por un para con no una su al lo como pero sus le ya o este porque esta entre
cuando muy sin sobre me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante
ellos e esto antes algunos unos yo otro otras otra tanto esa estos mucho quienes nada muchos cual poco ella estar
estas algunas algo nosotros mi mis tu te ti tus ellas nosotras vosotros vosotras os tuyo tuya tuyos tuyas suyo suya
suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas
estoy estamos estemos estaremos estad estando estado estada estados estadas estaba estabas estabais estaban
he has ha hemos han haya hayas hayamos hayan habremos habiendo habido habida habidos habidas
soy eres es somos sois son sea seas seamos sean seremos era eras erais eran siendo sido fui fuiste fue fuimos
fuisteis fueron tengo tienes tiene tenemos tienen tenga tengas tengamos tengan tendremos tened teniendo tenido
tenida tenidos tenidas
"""
_PAST_STEMS = ("estuv", "hub", "tuv")
_PAST_ENDINGS = ("e", "iste", "o", "imos", "isteis", "ieron")
_SUBJUNCTIVE_STEMS = ("estuvi", "hubi", "tuvi", "fu")
_SUBJUNCTIVE_ENDINGS = ("era", "eras", "erais", "eran", "ese", "eses", "eseis", "esen")
SPANISH_STOP = (set(SPANISH_STOP_WORDS.split())
                | {s + e for s in _PAST_STEMS for e in _PAST_ENDINGS}
                | {s + e for s in _SUBJUNCTIVE_STEMS for e in _SUBJUNCTIVE_ENDINGS})

# English exceptions and suffix tables.
ENGLISH_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
ENGLISH_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
ENGLISH_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
ENGLISH_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "", "ative": "",
}
ENGLISH_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti",
                 "ous", "ive", "ize", "ion"]

# Spanish suffix tables (unaccented forms).
SPANISH_PRONOUNS = ["me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos"]
SPANISH_GERUND_OR_INFINITIVE = ["ando", "iendo", "yendo", "ar", "er", "ir"]
SPANISH_PLAIN = ["anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles",
                 "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"]
SPANISH_AFTER_IC = ["adora", "ador", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"]
SPANISH_Y_VERBS = ["ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yas", "yes", "yais", "yamos"]
SPANISH_VERBS = ["aremos", "eremos", "iremos", "aba", "ada", "ida", "ara", "iera", "ad", "ed", "id", "ase", "iese",
                 "aste", "iste", "an", "aban", "aran", "ieran", "asen", "iesen", "aron", "ieron", "ado", "ido", "ando",
                 "iendo", "ar", "er", "ir", "as", "abas", "adas", "idas", "aras", "ieras", "ases", "ieses", "abais",
                 "arais", "ierais", "aseis", "ieseis", "asteis", "isteis", "ados", "idos", "amos", "imos"]
SPANISH_EN = ["en", "es", "emos"]
SPANISH_DERIVED = ["uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
SPANISH_STANDARD = SPANISH_PLAIN + SPANISH_AFTER_IC + SPANISH_DERIVED


def _regions(word: str, vowels: str, start: int = 0) -> tuple[int, int]:
    """Where R1 and R2 begin: after a consonant that follows a vowel, once and twice."""
    gap = re.compile(f"[{vowels}][^{vowels}]")
    first = gap.search(word)
    r1 = start or (first.end() if first else len(word))
    second = gap.search(word, r1)
    return r1, (second.end() if second else len(word))


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _short(word: str) -> bool:
    """Ends in a short syllable."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]\Z|\A[aeiouy][^aeiouy]\Z", word))


def english_stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in ENGLISH_WHOLE:
        return ENGLISH_WHOLE[word]
    w = re.sub(r"(?<=[aeiouy])y|\Ay", "Y", word)
    vowels = "aeiouy"
    known = re.match("gener|commun|arsen", w)
    r1, r2 = _regions(w, vowels, known.end() if known else 0)

    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in ENGLISH_KEEP:
        return w

    # Past and progressive forms.
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif ending and re.search("[aeiouy]", w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z", w):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    if re.search(r".[^aeiouy][yY]\Z", w):
        w = w[:-1] + "i"

    # Derivational suffixes, longest first, inside R1 or R2.
    ending = _longest(w, ENGLISH_STEP2)
    if ending and len(w) - len(ending) >= r1:
        before = w[: -len(ending)]
        if not (ending == "ogi" and not before.endswith("l")) and not (ending == "li" and before[-1:] not in "cdeghkmnrt"):
            w = before + ENGLISH_STEP2[ending]
    ending = _longest(w, ENGLISH_STEP3)
    if ending and len(w) - len(ending) >= (r2 if ending == "ative" else r1):
        w = w[: -len(ending)] + ENGLISH_STEP3[ending]
    ending = _longest(w, ENGLISH_STEP4)
    if ending and len(w) - len(ending) >= r2 and not (ending == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(ending)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _spanish_rv(word: str) -> int:
    v = "aeiou"
    if len(word) < 3:
        return len(word)
    if word[1] not in v:
        rest = re.search(f"[{v}]", word[2:])
    elif word[0] in v:
        rest = re.search(f"[^{v}]", word[2:])
    else:
        return 3
    return rest.end() + 2 if rest else len(word)


def _spanish_standard(w: str, r1: int, r2: int) -> str:
    """Nominal and adverbial suffixes; the word itself when none applies."""
    ending = _longest(w, SPANISH_STANDARD)
    if not ending:
        return w
    cut = len(w) - len(ending)

    def drop(stem: str, *preceding: str) -> str:
        for p in preceding:
            if stem.endswith(p):
                return stem[: -len(p)] if len(stem) - len(p) >= r2 else stem
        return stem

    if ending == "amente":
        if cut < r1:
            return w
        stem = w[:cut]
        shorter = drop(stem, "iv")
        return drop(shorter, "at") if shorter != stem else drop(stem, "os", "ic", "ad")
    if cut < r2:
        return w
    if ending == "uciones":
        return w[:cut] + "u"
    if ending in ("encia", "encias"):
        return w[:cut] + "ente"
    follow = {"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv"),
              "iva": ("at",), "ivo": ("at",), "ivas": ("at",), "ivos": ("at",)}
    return drop(w[:cut], *follow.get(ending, ("ic",) if ending in SPANISH_AFTER_IC else ()))


def spanish_stem(word: str) -> str:
    w = word
    rv = _spanish_rv(w)
    r1, r2 = _regions(w, "aeiou")

    pronoun = _longest(w, SPANISH_PRONOUNS)
    if pronoun and len(w) - len(pronoun) >= rv:
        host = w[: -len(pronoun)]
        base = _longest(host, SPANISH_GERUND_OR_INFINITIVE)
        if base and len(host) - len(base) >= rv and (base != "yendo" or host.endswith("uyendo")):
            w = host

    after = _spanish_standard(w, r1, r2)
    if after == w:
        verb = _longest(w[rv:], SPANISH_Y_VERBS)
        if verb and w[: -len(verb)].endswith("u"):
            after = w[: -len(verb)]
        else:
            verb = _longest(w[rv:], SPANISH_EN + SPANISH_VERBS)
            if verb:
                after = w[: -len(verb)]
                if verb in SPANISH_EN and after.endswith("gu"):
                    after = after[:-1]
    w = after

    if w[rv:].endswith("os"):
        w = w[:-2]
    elif w[rv:].endswith(("a", "o")):
        w = w[:-1]
    elif w[rv:].endswith("e"):
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w


def lexeme(word: str, language: str) -> str | None:
    """What a language's index stores for a word; None for stop words. Words with digits stay as they are."""
    if language == "simple" or not word.isalpha():
        return word
    if language == "spanish":
        return None if word in SPANISH_STOP else spanish_stem(word)
    return None if word in ENGLISH_STOP else english_stem(word)


def stems(word: Column, language: str) -> Column:
    """Arrow UDF over a column of distinct words."""
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: lexeme(w, language))

    return run(word)
