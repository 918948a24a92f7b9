"""Small SQL fragments for the comparison queries, written independently of the operators."""

from __future__ import annotations

from motoquant.functions import vocab as V


def rint(x: str) -> str:
    """Nearest whole number, ties to even."""
    return f"(CASE WHEN abs(({x}) - trunc({x})) = 0.5 THEN 2 * round(({x}) / 2) ELSE round({x}) END)"


def r_even(x: str, digits: int) -> str:
    k = f"CAST({10**digits} AS DOUBLE)"
    return f"({rint(f'CAST({x} AS DOUBLE) * {k}')} / {k})"


def to_num(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


def first(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def canonical_class(x: str) -> str:
    t = f"regexp_replace(upper({x}), '{V.BRAND_WORDS}', ' ', 'g')"
    t = f"regexp_replace({t}, '{V.GERMAN_CLASS_WORDS}', ' CLASS', 'g')"
    arms = "\n".join(
        rf"WHEN regexp_matches({t}, '\b{c}(\b|[ -]?\d)|{c} CLASS') THEN '{V.CLASS_ALIAS.get(c, c)}'"
        for c in V.CLASS_TOKENS
    )
    return f"(CASE {arms} END)"


def transmission(x: str) -> str:
    return f"""(CASE WHEN lower({x}) LIKE '%manual%' THEN 'Manual' WHEN lower({x}) LIKE '%semi%' THEN 'Semi-Auto'
        WHEN lower({x}) LIKE '%auto%' THEN 'Automatic' ELSE 'Other' END)"""


def fuel(x: str) -> str:
    return f"""(CASE WHEN lower({x}) LIKE '%hybrid%' THEN 'Hybrid' WHEN lower({x}) LIKE '%elect%' THEN 'Electric'
        WHEN lower({x}) LIKE '%diesel%' THEN 'Diesel' WHEN lower({x}) IN ('petrol', 'gas', 'gasoline') THEN 'Petrol'
        ELSE 'Other' END)"""


def badge(x: str) -> str:
    hit = rf"coalesce({first(f'replace({x}, chr(45), chr(32))', r'\b([1-6]\d0)\b')}, {first(x, r'[a-zA-Z]([1-6]\d0)\b')})"
    return f"round(CAST({hit} AS DOUBLE) / 100, 1)"


def class_label(x: str) -> str:
    t = f"upper(trim({x}))"
    plain = first(t, f"^({'|'.join(V.LABEL_CLASSES)})([ -]CLASS)?$")
    coupe = first(t, f"^({'|'.join(V.LABEL_COUPES)})[ -]COUPE$")
    return f"(coalesce({plain}, {coupe}) || '_CLASS')"


def uniform(key: str, salt: str, seed: int = 42) -> str:
    return (
        f"((CAST(('0x' || substr(md5('{seed}|{salt}|' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT)"
        f" + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"
    )


def gaussian(key: str, salt: str, std: float, seed: int = 42) -> str:
    return (
        f"(sqrt(CAST(-2 AS DOUBLE) * ln({uniform(key, salt + '-a', seed)}))"
        f" * cos(2 * pi() * {uniform(key, salt + '-b', seed)}) * CAST({std} AS DOUBLE))"
    )
