"""Queries of frames and views by case; fifty embeddings are the points of a case, every tenth of one role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clinical as op

_SHORT = dict(zip(op.ROLES, ("lv", "rv", "la", "ra", "mi", "tr", "ao", "pu", "sv", "iv"), strict=True))


def points(spark, sf_dir) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double") * 100
    roles = F.array(*map(F.lit, op.ROLES))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.floor(F.col("vec_id") / 50).alias("case"), F.element_at(roles, (F.col("vec_id") % 10 + 1).cast("int")).alias("role"), F.col("embedding")[3].cast("double").alias("along"), *[e(k).alias(x) for k, x in enumerate("xyz")])


def cardiac_frames(spark, sf_dir):
    """The frame of each case and what its nine checks say."""
    out = op.framed(op.landmarks(points(spark, sf_dir)))
    return out.select("case", F.round("long_axis", 5).alias("long_axis"), "n_checks", "n_passed", "failed", *[F.round(f"{n}_{x}", 5).alias(f"{n}_{x}") for n in ("apex", "base", "mitral") for x in "xyz"])


def clinical_views(spark, sf_dir):
    """Views of each case, with the landmarks that refuse them and the order of what they sweep over."""
    p = points(spark, sf_dir)
    return op.clinical_views(p, op.framed(op.landmarks(p)))


_V = lambda n: [f"{n}_{x}" for x in "xyz"]
_SUB = lambda a, b: [f"({p} - {q})" for p, q in zip(a, b, strict=True)]
_ADD = lambda a, b: [f"({p} + {q})" for p, q in zip(a, b, strict=True)]
_BY = lambda a, k: [f"({p} * {k})" for p in a]
_DOT = lambda a, b: "(" + " + ".join(f"{p}*{q}" for p, q in zip(a, b, strict=True)) + ")"
_X = lambda a, b: [f"({a[(k + 1) % 3]}*{b[(k + 2) % 3]} - {a[(k + 2) % 3]}*{b[(k + 1) % 3]})" for k in range(3)]
_UNIT = lambda a: [f"({c} / sqrt({_DOT(a, a)}))" for c in a]
_FACE = lambda a, s: [f"(CASE WHEN {s} < 0 THEN -({c}) ELSE {c} END)" for c in a]
_AS = lambda name, vec: ", ".join(f"{c} AS {name}_{x}" for c, x in zip(vec, "xyz", strict=True))
_ZED = ["0", "0", "1"]
_ALL = ["apex", "base", *_SHORT.values()]
_BASIS = [_V("lf"), _V("lo"), _V("fr")]
FRAMES = f"""WITH p AS (SELECT vec_id // 50 AS cs, vec_id % 10 AS role, embedding[4]::DOUBLE AS along, embedding[1]::DOUBLE*100 AS x, embedding[2]::DOUBLE*100 AS y, embedding[3]::DOUBLE*100 AS z FROM embeddings),
ce AS (SELECT cs, {", ".join(f"avg({x}) FILTER (role = {k}) AS {n}_{x}" for k, n in enumerate(_SHORT.values()) for x in "xyz")} FROM p GROUP BY 1),
lq AS (SELECT cs, quantile_cont(along, 0.01) AS q FROM p WHERE role = 0 AND along >= -1 GROUP BY 1),
ap AS (SELECT cs, {", ".join(f"avg({x}) AS apex_{x}" for x in "xyz")} FROM p JOIN lq USING (cs) WHERE role = 0 AND along >= -1 AND along <= q GROUP BY 1),
f0 AS (SELECT *, {_AS("base", _BY(_ADD(_ADD(_V("mi"), _V("tr")), _ADD(_V("ao"), _V("pu"))), "0.25::DOUBLE"))} FROM ce JOIN ap USING (cs)),
f1 AS (SELECT *, {_AS("lo", _UNIT(_SUB(_V("base"), _V("apex"))))}, {_AS("rw", _SUB(_V("la"), _V("ra")))} FROM f0),
f2 AS (SELECT *, {_AS("lf", _UNIT(_SUB(_V("rw"), _BY(_V("lo"), _DOT(_V("rw"), _V("lo"))))))} FROM f1), f3 AS (SELECT *, {_AS("fr", _X(_V("lf"), _V("lo")))} FROM f2),
fm AS (SELECT cs, {", ".join(_AS(a, _V(a)) for a in ("lf", "lo", "fr"))}, sqrt({_DOT(_SUB(_V("base"), _V("apex")), _SUB(_V("base"), _V("apex")))}) AS long_axis, {", ".join(_AS(n, [_DOT(a, _V(n)) for a in _BASIS]) for n in _ALL)} FROM f3)"""
_CHECKS = {
    "pulmonary valve before aortic valve": "pu_z > ao_z", "mitral valve left of tricuspid valve": "mi_x > tr_x", "left ventricle left of right one": "lv_x > rv_x", "aortic valve right of mitral valve": "ao_x < mi_x", "left atrium basal to left ventricle": "la_y > lv_y",
    "right atrium basal to right ventricle": "ra_y > rv_y", "upper vein basal to the valves": "sv_y > base_y", "lower vein behind the upper one": "iv_z < sv_z", "apex beyond every valve": "apex_y < least(mi_y, tr_y, ao_y, pu_y)",
}
CARDIAC = f"""{FRAMES}, ck AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {t} THEN NULL ELSE '{n}' END" for n, t in _CHECKS.items())}], lambda s: s IS NOT NULL) AS bad FROM fm)
SELECT cs AS case, round(long_axis, 5) AS long_axis, 9 AS n_checks, 9 - len(bad)::INT AS n_passed, array_to_string(bad, '; ') AS failed, {", ".join(f"round({s}_{x}, 5) AS {n}_{x}" for n, s in (("apex", "apex"), ("base", "base"), ("mitral", "mi")) for x in "xyz")} FROM ck"""


def _view(name: str, steps: list[dict[str, list[str]]], half: float, tilt: tuple[float, float] | None, holds: dict[str, str], meets: dict[str, str]) -> str:
    source, made = "fm", set()
    for s in steps:
        old = [n for n in s if n in made]
        keep = f"* EXCLUDE ({', '.join(c for n in old for c in _V(n))})" if old else "*"
        source = f"(SELECT {keep}, {', '.join(_AS(n, vec) for n, vec in s.items())} FROM {source})"
        made |= set(s)
    low, high = tilt or (0, 0)
    mark = lambda what: "[" + ", ".join(f"{{'name': '{n}', 'x': {s}_x, 'y': {s}_y, 'z': {s}_z}}" for n, s in what.items()) + "]" if what else "[]"
    cols = ", ".join(c for n in ("th", "bm", "sd", "tn", "apex") for c in _V(n))
    return f"SELECT cs, '{name}' AS view_id, {cols}, {half}::DOUBLE AS half, {'true' if tilt else 'false'} AS tilts, {low}::DOUBLE AS low, {high}::DOUBLE AS high, {mark(holds)} AS holds, {mark(meets)}::STRUCT(name VARCHAR, x DOUBLE, y DOUBLE, z DOUBLE)[] AS meets FROM {source}"


_PLANE = lambda p, q: {"n": _UNIT(_X(_SUB(_V(p), _V("apex")), _SUB(_V(q), _V("apex"))))}
_HALF = lambda p, q: _BY(_ADD(_V(p), _V(q)), "0.5::DOUBLE")
_TURN = {"sd": _UNIT(_X(_V("n"), _V("bm"))), "tn": _UNIT(_X(_V("bm"), _V("n")))}
_FOUR = _view("b1-apical-four-chamber", [_PLANE("mi", "tr"), {"n": _FACE(_V("n"), "n_z")}, {"th": _V("apex"), "bm": _UNIT(_SUB(_HALF("mi", "tr"), _V("apex")))}, _TURN, {"sd": _FACE(_V("sd"), _DOT(_V("sd"), _SUB(_V("mi"), _V("tr"))))}], 40, (-18, 22), {"mitral": "mi", "tricuspid": "tr", "apex": "apex"}, {})
_LONG = _view("c1-parasternal-long-axis", [_PLANE("mi", "ao"), {"n": _FACE(_V("n"), "n_x")}, {"th": _HALF("mi", "ao"), "bm": _BY(_UNIT(_SUB(_ZED, _BY(_V("n"), "n_z"))), "-1")}, _TURN, {"sd": _FACE(_V("sd"), _DOT(_V("sd"), _SUB(_V("base"), _V("apex"))))}], 35, (-20, 20), {"mitral": "mi", "aortic": "ao"}, {"apex": "apex"})
_SHORT_AXIS = _view("c2-parasternal-short-axis", [{"tn": _UNIT(_SUB(_V("apex"), _V("base")))}, {"bm": _UNIT(_BY(_SUB(_ZED, _BY(_V("tn"), "tn_z")), "-1")), "th": _ADD(_V("base"), _BY(_V("tn"), f"({_DOT(_SUB(_V('ao'), _V('base')), _V('tn'))} + 2)"))}, {"sd": _UNIT(_X(_V("tn"), _V("bm")))}, {"sd": _FACE(_V("sd"), "sd_x")}], 35, None, {"aortic": "ao"}, {})
_P = ["q_x", "q_y", "q_z"]
_PART = lambda o: (_DOT([f"(m.{x} - og_{x})" for x in "xyz"], _V(o)))
_OFF = f"abs({_PART('nm')})"
_OUT = f"NOT ({_OFF} <= 6 AND abs(atan2({_PART('sd')}, {_PART('bm')})) <= radians(half) AND sqrt({_PART('sd')}**2 + {_PART('bm')}**2) <= depth_cm * 10)"
_ROT = lambda n: [f"({c}*ca + {x}*sa + {t}*{_DOT(_V('tn'), _V(n))}*(1-ca))" for c, x, t in zip(_V(n), _X(_V("tn"), _V(n)), _V("tn"), strict=True)]
CLINICAL = f"""{FRAMES}, vw AS ({_FOUR} UNION ALL BY NAME {_LONG} UNION ALL BY NAME {_SHORT_AXIS}),
pr AS (SELECT cs, role, {", ".join(f"{_DOT(a, ['x', 'y', 'z'])} AS q_{x}" for a, x in zip(_BASIS, "xyz", strict=True))} FROM p JOIN fm USING (cs)),
bh AS (SELECT cs, view_id, max({_DOT(_SUB(_V("th"), _P), _V("bm"))}) AS behind FROM pr JOIN vw USING (cs) GROUP BY 1, 2),
v1 AS (SELECT vw.*, {_AS("og", _SUB(_V("th"), _BY(_V("bm"), "(greatest(behind, 0) + 8)")))}, {_AS("nm", _X(_V("bm"), _V("sd")))} FROM vw JOIN bh USING (cs, view_id)),
dp AS (SELECT cs, view_id, coalesce(max(sqrt({_DOT(_SUB(_P, _V("og")), _SUB(_P, _V("og")))})) FILTER (abs({_DOT(_SUB(_P, _V("og")), _V("nm"))}) <= 12), max(sqrt({_DOT(_SUB(_P, _V("og")), _SUB(_P, _V("og")))}))) AS deep FROM pr JOIN v1 USING (cs) GROUP BY 1, 2),
v2 AS (SELECT v1.* REPLACE (CASE WHEN tilts THEN high ELSE round({_DOT(_SUB(_V("apex"), _V("og")), _V("tn"))} * 0.88::DOUBLE, 1) END AS high), round(deep * 1.08::DOUBLE / 10, 2) AS depth_cm FROM v1 JOIN dp USING (cs, view_id)),
rs AS (SELECT *, nullif(array_to_string(list_concat(list_transform(list_filter(holds, lambda m: {_OUT}), lambda m: 'does not hold ' || m.name || ' ' || round({_OFF}, 1)), list_transform(list_filter(meets, lambda m: {_OFF} > 6), lambda m: 'misses ' || m.name || ' ' || round({_OFF}, 1))), '; '), '') AS refused FROM v2),
st AS (SELECT *, low + (high - low) * s / 60.0::DOUBLE AS rd FROM rs, range(61) r(s) WHERE refused IS NULL), an AS (SELECT *, cos(CASE WHEN tilts THEN radians(rd) ELSE 0 END) AS ca, sin(CASE WHEN tilts THEN radians(rd) ELSE 0 END) AS sa, CASE WHEN tilts THEN 0 ELSE rd END AS sl FROM st),
po AS (SELECT cs, view_id, s, half, depth_cm, {_AS("og", _ADD(_V("og"), _BY(_V("tn"), "sl")))}, {_AS("bm", _ROT("bm"))}, {_AS("sd", _ROT("sd"))} FROM an),
hi AS (SELECT cs, view_id, role, s FROM po JOIN pr USING (cs) WHERE abs({_DOT(_SUB(_P, _V("og")), _X(_V("bm"), _V("sd")))}) <= 6 AND abs(atan2({_DOT(_SUB(_P, _V("og")), _V("sd"))}, {_DOT(_SUB(_P, _V("og")), _V("bm"))})) <= radians(half) AND sqrt({_DOT(_SUB(_P, _V("og")), _V("sd"))}**2 + {_DOT(_SUB(_P, _V("og")), _V("bm"))}**2) <= depth_cm * 10),
sz AS (SELECT cs, role, count(*) AS n FROM pr GROUP BY 1, 2), fs AS (SELECT cs, view_id, role, min(s) AS step, any_value(n) AS n FROM hi JOIN sz USING (cs, role) GROUP BY 1, 2, 3),
od AS (SELECT cs, view_id, count(*) < 2 OR min(step) = max(step) AS vacuous, string_agg([{", ".join(f"'{r}'" for r in op.ROLES)}][role + 1], ',' ORDER BY step, -n, [{", ".join(f"'{r}'" for r in op.ROLES)}][role + 1]) AS names FROM fs GROUP BY 1, 2)
SELECT cs AS case, view_id, refused, depth_cm, CASE WHEN refused IS NULL THEN coalesce(vacuous, true) END AS vacuous, CASE WHEN refused IS NULL THEN CASE WHEN coalesce(vacuous, true) THEN '' ELSE names END END AS structures_in_order FROM rs LEFT JOIN od USING (cs, view_id)
UNION ALL SELECT cs, n.view_id, n.refused, NULL, NULL, NULL FROM fm, (VALUES {", ".join(f"('{n}', '{w}')" for n, w in op.NOT_BUILT.items())}) n(view_id, refused)"""

QUERIES = {f.__name__: f for f in (cardiac_frames, clinical_views)}
ORACLES = {"cardiac_frames": CARDIAC, "clinical_views": CLINICAL}
