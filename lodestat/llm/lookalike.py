"""One form for texts that look the same.

A text is put through compatibility normalisation, its look-alike letters, hyphens and apostrophes
are mapped to one shape, spaces to the ordinary space, and characters that show nothing are dropped.
The folded form also folds case in full; it is the key on which texts meet.  Both forms are
computed once for each distinct text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters of other alphabets shaped like Latin letters, by the letter that they look like.
SHAPES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "E": "ΕЕᎬ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚКᏦ", "L": "Ꮮ",
    "M": "ΜМᎷϺ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ",
    "Y": "ΥҮ", "Z": "ΖᏃ", "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "f": "ẝ", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "οоօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү", "k": "",
}
#: Kinds of hyphen and minus, and of apostrophe.
HYPHENS = "‐‑‒–⁃˗−﹣－֊"
APOSTROPHES = "’‘‛ʼʻˈ′＇`´ʹꞌ՚"

_MAP = {ord(c): to for to, chars in SHAPES.items() for c in chars}
_MAP |= {ord(c): "-" for c in HYPHENS} | {ord(c): "'" for c in APOSTROPHES}
#: Default-ignorable characters: format controls, fillers and variation selectors.
_IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]+")
_SPACE = regex.compile(r"[\p{Zs}\t]")


def visible_form(text: str | None) -> str | None:
    """The form that texts of the same look share; null stays null."""
    if text is None:
        return None
    if text.isascii():
        return text.replace("`", "'").replace("\t", " ").strip()
    text = _IGNORABLE.sub("", text).translate(_MAP)
    text = unicodedata.normalize("NFKC", text)
    text = _IGNORABLE.sub("", text).translate(_MAP)
    text = unicodedata.normalize("NFKC", _SPACE.sub(" ", text))
    return text.strip()


def folded_form(visible: str | None) -> str | None:
    """A visible form with case folded in full."""
    return None if visible is None else unicodedata.normalize("NFKC", visible.casefold())


def _forms(texts: pd.Series) -> pd.DataFrame:
    visible = texts.map(visible_form, na_action="ignore")
    return pd.DataFrame({"visible": visible, "folded": visible.map(folded_form, na_action="ignore")})


def _per_distinct(texts: pd.Series) -> pd.DataFrame:
    """The forms of a batch, once for each distinct text."""
    codes, values = pd.factorize(texts)
    forms = _forms(pd.Series(values, dtype=object)).reindex(codes).reset_index(drop=True)
    return forms.where(forms.notna(), None)


def normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_visible`` and ``<column>_folded`` for each of the text columns.

    Nulls stay null, repeated rows stay; empty tables give none.  Raises if a new name is taken.
    Forms are computed in place, one batch at a time, once for each distinct text of the batch.
    """
    taken = {c.lower() for c in df.columns}
    for c in columns:
        if {f"{c}_visible".lower(), f"{c}_folded".lower()} & taken:
            raise ValueError(f"{c}_visible or {c}_folded is taken")

    forms = F.pandas_udf(_per_distinct, "visible string, folded string")
    for c in columns:
        df = df.withColumn("__f", forms(F.col(c).cast("string"))).withColumns({f"{c}_visible": F.col("__f.visible"), f"{c}_folded": F.col("__f.folded")}).drop("__f")
    return df


def same_look(left: DataFrame, right: DataFrame, *, within: str, left_text: str, right_text: str) -> DataFrame:
    """Pairs of texts of the same ``within`` that look the same but differ.

    Gives all columns of both sides but the second ``within``, which must not clash otherwise.  Texts meet on the
    folded form and are then compared exactly on the visible form, for case shows.  Null texts and
    null ``within`` never pair; blank texts look the same as other blank texts.  Repeated rows pair repeatedly.

    Scale: forms in place, once for each distinct text of a batch; one equi-join on (within, hash of the folded form), which spreads a
    large ``within`` by its texts.  Texts are compared by 256-bit digests, so that only columns that are asked for are shuffled.
    """
    clash = (set(left.columns) & set(right.columns)) - {within}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    forms = F.pandas_udf(_per_distinct, "visible string, folded string")
    digest = lambda c: F.unhex(F.sha2(F.col(c), 256))

    def side(df: DataFrame, text: str, name: str) -> DataFrame:
        known = df.where(F.col(text).isNotNull() & F.col(within).isNotNull()).withColumn("__f", forms(F.col(text).cast("string")))
        return known.select(*df.columns, F.xxhash64("__f.folded").alias("__fold"), digest("__f.visible").alias(f"__{name}v"), digest(text).alias(f"__{name}t"))

    pairs = side(left, left_text, "l").join(side(right, right_text, "r"), [within, "__fold"])
    return pairs.where((F.col("__lv") == F.col("__rv")) & (F.col("__lt") != F.col("__rt"))).drop("__fold", "__lv", "__rv", "__lt", "__rt")
