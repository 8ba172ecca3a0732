"""Terms by language: stop words are left out and endings cut off, the same for documents and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

# Common words of each language, and the endings that are cut off.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you".split(),
    "de": "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer eines er es für hat ich im in ist mit nicht noch nur oder sich sie sind so um und von war wie wir zu zum zur".split(),
    "fr": "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous".split(),
    "es": "a al como con de del el ella en entre es esta este ha la las lo los más me mi no nos o para pero por que se ser si sin sobre son su sus un una y ya".split(),
}
ENDINGS = {
    "en": "ations ation ingly ings ing edly ed ness ment ments ies es e ly s".split(),
    "de": "ungen ung heiten heit keiten keit lich ern em en er es e n s".split(),
    "fr": "ations ation ements ement ités ité euses euse ées ée és é er es e s".split(),
    "es": "aciones ación mente idades idad ados adas ado ada os as es o a s".split(),
}
#: Letters that a cut leaves at least.
STEM = 3


def pattern(language: str) -> str:
    """A whole word, with what is left of it when its longest ending goes as the first group."""
    return f"^(.{{{STEM},}}?)(?:{'|'.join(ENDINGS[language])})$"


def terms(text: Column, language: Column) -> Column:
    """The tokens of text, in its language's terms; those of other languages or of none stay as they are."""
    plain = tokens(text)

    def of(name: str) -> Column:
        told = F.filter(plain, lambda t: ~t.isin(*STOP_WORDS[name]))
        return F.transform(told, lambda t: F.regexp_replace(t, pattern(name), "$1"))

    first, *others = STOP_WORDS
    out = F.when(language == first, of(first))
    for name in others:
        out = out.when(language == name, of(name))
    return out.otherwise(plain)
