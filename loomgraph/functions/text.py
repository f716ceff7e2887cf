"""Scalar functions on names, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_name(c: Column) -> Column:
    """Trimmed and lower; a charge at the end and one stereo prefix go; letters, digits and spaces stay."""
    c = F.lower(F.trim(c))
    c = F.regexp_replace(c, r"\s*\(\d*[+-]\)$", "")
    c = F.regexp_replace(c, r"^\((?:r|s|e|z|\+|-)\)-", "")
    return F.trim(F.regexp_replace(c, "[^a-z0-9 ]", ""))


def family_key(c: Column) -> Column:
    """First three longer tokens of a name without digits and (human); null below two."""
    t = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(c), r"\(human\)", ""), "[0-9]", ""), "[,\\- ]"), lambda x: F.length(x) > 2)
    return F.when(F.size(t) >= 2, F.concat_ws(" ", F.slice(t, 1, 3)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


# Endings that name a salt or a hydrate, what is no compound by itself, and prefixes of stereoisomers.
SALTS = (
    "hydrochloride", "hydrobromide", "sulfate", "sulphate", "acetate", "sodium", "potassium", "calcium", "magnesium", "chloride", "citrate", "maleate",
    "mesylate", "tartrate", "phosphate", "besylate", "fumarate", "succinate", "bromide", "nitrate", "oxalate", "lactate", "gluconate", "stearate", "palmitate",
)
HYDRATES = ("anhydrous", "hydrate", "monohydrate", "dihydrate", "trihydrate", "sesquihydrate")
COUNTERIONS = (
    "sodium", "potassium", "calcium", "magnesium", "lithium", "zinc", "ammonium", "iron", "aluminium", "aluminum", "chloride", "bromide", "iodide",
    "sulfate", "sulphate", "phosphate", "nitrate", "acetate", "citrate", "carbonate", "hydroxide", "oxide",
)
STEREO = ("(+/-)", "(+)", "(-)", "(r)", "(s)", "(e)", "(z)", "(rs)", "trans", "cis", "dl", "d", "l")


def compound_key(label: str | None, strip_stereo: bool = False) -> str:
    """One key for the salts, hydrates, charges and, if asked for, stereoisomers of a compound; "" for none.

    Works on the words of the name: up to three hydrates go from its end, then
    salts as long as what is left is a compound of five characters or more.
    """
    name = re.sub(r"\(\d*[+-]\)", "", re.sub(r"\s*\(human\)$", "", (label or "").lower().strip()))
    words = name.split()
    for _ in range(3):
        if len(words) > 1 and words[-1] in HYDRATES:
            words.pop()
    while len(words) > 1 and words[-1] in SALTS:
        rest = " ".join(words[:-1])
        if rest in COUNTERIONS or len(rest) < 5:
            break
        words.pop()
    rest = " ".join(words)
    while strip_stereo:
        prefix = next((p for p in STEREO if rest.startswith(p) and rest[len(p) : len(p) + 1] in (" ", "-")), None)
        if prefix is None:
            break
        rest = rest[len(prefix) + 1 :].strip()
    return re.sub("[^a-z0-9]", "", rest)


def compound_keys(strip_stereo: bool):
    """``compound_key`` as a column function over Arrow batches."""

    @F.pandas_udf("string")
    def key(labels: pd.Series) -> pd.Series:
        return labels.map(lambda x: compound_key(x if isinstance(x, str) else None, strip_stereo))

    return key
