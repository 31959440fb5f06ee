"""Checks of packs: each pack is a JSON document in a row, each finding a row (path, issue, severity).

All checks look at one pack only and are array expressions over its parsed columns, so packs are
checked where they lie, without a shuffle. Paths are dotted, with numbers for places in lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

VERSION = "0"
_PROVENANCE = "struct<creator:string,source:string,source_url:string,license:string,license_url:string,modified:struct<flag:boolean,note:string>,derivation_chain:array<string>,vetted:struct<status:string,vetters:array<struct<name:string,role:string,date:string>>,last_reviewed:string>>"
#: The typed columns of a pack that the checks read.
SCHEMA = f"""meta struct<id:string,display_name:string,anatomy:string,canonical_variant:string,pack_version:string>,
provenance {_PROVENANCE},
meshes struct<gltf:string,structures:array<struct<id:string,mesh_node:string,display_label:string,parent:string,blood_pool:boolean,stylized:boolean>>,canonical_pose:struct<scale:double>,units:string,orientation:struct<up:string,anterior:string,patient_left:string,handedness:string>>,
interaction struct<camera:struct<position:array<double>,target:array<double>,up:array<double>,fov_deg:double>,free_cut:struct<normal:array<double>,offset:double>>,
echo_volume struct<asset:string,format:string,resolution:array<int>,mesh_to_volume:array<double>,labels:array<struct<id:int,structure:string,echogenicity:double,attenuation:double>>>,
views array<struct<family:string,view_id:string,name:string,indicator_clock:string,probe:struct<beam_axis:array<double>,lateral_axis:array<double>,fan:struct<angle_deg:double,depth_cm:double,focus_cm:double>>,sweep:struct<mode:string,axis:struct<direction:array<double>>,range:struct<unit:string,`from`:double,`to`:double>,structures_in_order:array<string>>,structures:array<string>,show_hide_preset:struct<visible:array<string>,hidden:array<string>>,provenance:{_PROVENANCE}>>"""
#: The keys of each level.
KEYS = {
    "": "meta provenance meshes interaction echo_volume views display_flags volumetric_data".split(),
    "meta": "id display_name anatomy canonical_variant pack_version schema_version".split(),
    "provenance": "creator source source_url license license_url modified derivation_chain vetted".split(),
    "meshes": "gltf structures canonical_pose units orientation anatomical_frame".split(),
    "structure": "id mesh_node display_label parent blood_pool stylized".split(),
    "label": "id structure echogenicity attenuation".split(),
    "modified": "flag note".split(),
    "vetted": "status vetters last_reviewed".split(),
    "vetter": "name role date".split(),
    "canonical_pose": "position rotation_euler_xyz_deg scale".split(),
    "orientation": "up anterior patient_left handedness".split(),
    "anatomical_frame": "method description inputs valve_identification landmarks_source_mm basis_source_to_pack measurements checks checks_passed checks_total".split(),
    "basis": "patient_left basal anterior".split(),
    "valve_identification": "method description chamber_tags valves published_tags agrees_with_published".split(),
    "interaction": "pivot camera free_cut".split(),
    "camera": "position target up fov_deg".split(),
    "free_cut": "normal offset".split(),
    "echo_volume": "asset format resolution mesh_to_volume labels scatterer_seed".split(),
    "probe": "origin beam_axis lateral_axis fan display".split(),
    "fan": "angle_deg depth_cm focus_cm".split(),
    "display": "vertex marker_side flip_lr".split(),
    "sweep": "mode axis range interpolation structures_in_order".split(),
    "axis": "direction origin".split(),
    "range": "unit from to".split(),
    "show_hide_preset": "visible hidden".split(),
    "view": "family view_id name aliases placement_landmark indicator_clock probe sweep structures measurements lesion_attachments show_hide_preset echo_tuning real_clip_slot emphasis provenance".split(),
}
#: Where an object of a level lies, in a pack and in a view.
PLACES = {"meta": "meta", "provenance": "provenance", "provenance.modified": "modified", "provenance.vetted": "vetted", "meshes": "meshes", "meshes.canonical_pose": "canonical_pose", "meshes.orientation": "orientation", "meshes.anatomical_frame": "anatomical_frame", "meshes.anatomical_frame.basis_source_to_pack": "basis", "meshes.anatomical_frame.valve_identification": "valve_identification", "interaction": "interaction", "interaction.camera": "camera", "interaction.free_cut": "free_cut", "echo_volume": "echo_volume"}
VIEW_PLACES = {"probe": "probe", "probe.fan": "fan", "probe.display": "display", "sweep": "sweep", "sweep.axis": "axis", "sweep.range": "range", "show_hide_preset": "show_hide_preset", "provenance": "provenance", "provenance.modified": "modified", "provenance.vetted": "vetted"}
#: Fields that must be text and numbers, in a pack.
TEXTS = ("meta.id", "meta.display_name", "meta.anatomy", "meta.canonical_variant", "meta.pack_version", "meta.schema_version", "provenance.creator", "provenance.source", "provenance.license", "meshes.gltf", "meshes.units", "echo_volume.asset", "echo_volume.format")
NUMBERS = ("meshes.canonical_pose.scale", "interaction.camera.fov_deg", "interaction.free_cut.offset", "echo_volume.scatterer_seed")
FRAME = "meshes struct<anatomical_frame:struct<basis_source_to_pack:struct<patient_left:array<double>,basal:array<double>,anterior:array<double>>,checks:map<string,boolean>,checks_passed:int,checks_total:int,valve_identification:struct<valves:map<string,struct<tag:int,borders:map<string,int>>>,published_tags:map<string,int>,agrees_with_published:boolean>>>"
UNIT_SLACK = 1e-3


def _issue(path: Column | str, what: str, found: Column, severity: str = "failure") -> Column:
    """An array with the finding if ``found`` is true, else none."""
    row = F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(what).alias("issue"), F.lit(severity).alias("severity"))
    return F.when(F.coalesce(found, F.lit(False)), F.array(row)).otherwise(F.array().cast("array<struct<path:string,issue:string,severity:string>>"))


def _all(*parts: Column) -> Column:
    return F.concat(*parts)


def _each(items: Column, path: str, check) -> Column:
    """Findings of ``check(item, path of the item, place)`` over a list; a missing list has none."""
    at = lambda i: F.concat(F.lit(f"{path}."), i.cast("string"))
    return F.coalesce(F.flatten(F.transform(items, lambda x, i: check(x, at(i), i))), F.array().cast("array<struct<path:string,issue:string,severity:string>>"))


def _missing(value: Column) -> Column:
    return value.isNull() | (value == "")


def _dot(a: Column, b: Column) -> Column:
    # a part that is not there makes the product null, where an index fails the job
    return sum((F.get(a, F.lit(k)) * F.get(b, F.lit(k)) for k in range(3)), F.lit(0.0))


def _not_unit(v: Column) -> Column:
    return v.isNull() | (F.size(v) != 3) | (F.abs(F.sqrt(_dot(v, v)) - 1) > UNIT_SLACK)


def _parallel(a: Column, b: Column) -> Column:
    return F.abs(_dot(a, b)) >= (1 - 1e-6) * F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))


def schema_version(whole: Column) -> Column:
    """The version of a parsed pack as text if it is text or a number, else null."""
    value = F.try_variant_get(whole, "$.meta.schema_version", "variant")
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "string"))


def _unknown(keys: Column, level: str) -> Column:
    return F.size(F.array_except(keys, F.array(*map(F.lit, KEYS[level])))) > 0


def _keys(parsed: Column, place: str = "") -> Column:
    """Keys of the object at a place of a parsed value, which is not parsed again; those of a text that holds an object, else null."""
    path = f"$.{place}" if place else "$"
    return F.coalesce(F.map_keys(F.try_variant_get(parsed, path, "map<string,variant>")), F.json_object_keys(F.try_variant_get(parsed, path, "string")))


def _provenance(p: Column, path) -> Column:
    """Completeness of a provenance record: no empty or placeholder text, a note for changes, a chain, vetters behind a vetting."""
    at = lambda tail: F.concat(F.lit(path) if isinstance(path, str) else path, F.lit(f".{tail}"))
    fields = [_all(_issue(at(f), "missing", _missing(p[f])), _issue(at(f), "placeholder", text.is_placeholder(p[f]))) for f in ("creator", "source", "license")]
    links = [_issue(at(f), "not http", ~text.is_http(p[f])) for f in ("source_url", "license_url")]
    vetted, vetters = p["vetted"]["status"] == "vetted", p["vetted"]["vetters"]
    return _all(
        *fields,
        *links,
        _issue(at("modified.note"), "changes without a note", p["modified"]["flag"] & _missing(F.trim(p["modified"]["note"]))),
        _issue(at("derivation_chain"), "empty", F.coalesce(F.size(p["derivation_chain"]), F.lit(0)) <= 0),
        _issue(at("vetted.vetters"), "vetted by nobody", vetted & (F.coalesce(F.size(vetters), F.lit(0)) <= 0)),
        _issue(at("vetted.last_reviewed"), "vetted without a date", vetted & ~text.is_date(p["vetted"]["last_reviewed"])),
        _issue(at("vetted.vetters"), "vetter without a name", vetted & F.exists(vetters, lambda v: _missing(v["name"]) | text.is_placeholder(v["name"]))),
    )


def _repeats(values: Column, path: str, key: str) -> Column:
    """Second and later elements with the same key, of which ``values`` are the texts."""
    return _each(values, path, lambda x, at, i: _issue(F.concat(at, F.lit(f".{key}")), "repeated", F.array_position(values, x) < i + 1))


def _unresolved(names: Column, known: Column, path: Column) -> Column:
    return F.coalesce(F.flatten(F.transform(names, lambda n, i: _issue(F.concat(path, F.lit("."), i.cast("string")), "unknown structure", ~F.array_contains(known, n)))), F.array().cast("array<struct<path:string,issue:string,severity:string>>"))


def _structures(structures: Column, known: Column, parents: Column) -> Column:
    # after as many steps as there are structures a walk to the root has ended, unless it is in a cycle
    walked = lambda s: F.aggregate(parents, s["parent"], lambda node, _: F.get(parents, (F.array_position(known, node) - 1).cast("int")))
    return _each(
        structures,
        "meshes.structures",
        lambda s, at, i: _all(
            *[_issue(F.concat(at, F.lit(f".{f}")), "missing", _missing(s[f])) for f in ("id", "mesh_node", "display_label")],
            _issue(F.concat(at, F.lit(".id")), "not a slug", ~s["id"].rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$")),
            _issue(F.concat(at, F.lit(".parent")), "unknown structure", s["parent"].isNotNull() & ~F.array_contains(known, s["parent"])),
            _issue(F.concat(at, F.lit(".parent")), "cycle", F.array_contains(known, walked(s))),
        ),
    )


def _camera(c: Column) -> Column:
    """The first of: position equal to target, up along the view. Then the field of view."""
    along = F.zip_with(c["target"], c["position"], lambda a, b: a - b)
    return _all(
        _issue("interaction.camera.target", "camera at its target", _dot(along, along) == 0),
        _issue("interaction.camera.up", "up along the view", (_dot(along, along) > 0) & (_parallel(along, c["up"]) | (_dot(c["up"], c["up"]) == 0))),
        _issue("interaction.camera.fov_deg", "out of range", c.isNotNull() & ~F.coalesce((c["fov_deg"] > 0) & (c["fov_deg"] <= 179), F.lit(False))),
    )


def _views(views: Column, known: Column) -> Column:
    def check(v: Column, at: Column, i: Column) -> Column:
        under = lambda tail: F.concat(at, F.lit(f".{tail}"))
        probe, sweep, preset = v["probe"], v["sweep"], v["show_hide_preset"]
        fan, axes = probe["fan"], (probe["beam_axis"], probe["lateral_axis"])
        unit = F.when(sweep["mode"] == "translate", "mm").otherwise("deg")
        return _all(
            *[_issue(under(f), "missing", _missing(v[f])) for f in ("family", "view_id", "name")],
            _issue(under("indicator_clock"), "not a clock", ~F.coalesce(v["indicator_clock"].rlike(r"^(1[0-2]|[1-9]):[0-5]\d$"), F.lit(False))),
            *[_issue(under(f"probe.{n}"), "not a unit vector", _not_unit(a)) for n, a in zip(("beam_axis", "lateral_axis"), axes, strict=True)],
            _issue(under("probe.lateral_axis"), "not across the beam", ~_not_unit(axes[0]) & ~_not_unit(axes[1]) & (F.abs(_dot(*axes)) > UNIT_SLACK)),
            _issue(under("probe.fan.angle_deg"), "out of range", ~F.coalesce((fan["angle_deg"] > 0) & (fan["angle_deg"] <= 180), F.lit(False))),
            _issue(under("probe.fan.focus_cm"), "focus below the depth", fan["focus_cm"] > fan["depth_cm"]),
            _issue(under("sweep.range.unit"), "wrong unit", sweep.isNotNull() & ~F.coalesce(sweep["range"]["unit"] == unit, F.lit(False))),
            _issue(under("sweep.range"), "no extent", sweep["range"]["from"] == sweep["range"]["to"]),
            _unresolved(v["structures"], known, under("structures")),
            _unresolved(preset["visible"], known, under("show_hide_preset.visible")),
            _unresolved(preset["hidden"], known, under("show_hide_preset.hidden")),
            _unresolved(sweep["structures_in_order"], known, under("sweep.structures_in_order")),
            _issue(under("show_hide_preset"), "shown and hidden", F.arrays_overlap(preset["visible"], preset["hidden"])),
            _provenance(v["provenance"], under("provenance")),
        )

    return _each(views, "views", check)


def _orientation(o: Column) -> Column:
    """Three different axes whose determinant has the sign of the handedness."""
    names = [o[n] for n in ("patient_left", "up", "anterior")]
    letters = F.array(*[F.substring(n, 2, 1) for n in names])
    sign = lambda n: F.when(F.substring(n, 1, 1) == "-", -1).otherwise(1)
    # parity of the order of the letters: even for xyz, yzx, zxy
    even = F.array_join(letters, "").isin("xyz", "yzx", "zxy")
    determinant = F.when(even, 1).otherwise(-1) * sign(names[0]) * sign(names[1]) * sign(names[2])
    distinct = F.size(F.array_distinct(letters)) == 3
    return _all(
        _issue("meshes.orientation", "axes repeat", ~distinct),
        _issue("meshes.orientation.handedness", "does not fit the axes", distinct & (determinant != F.when(o["handedness"] == "right", 1).otherwise(-1))),
    )


def _wrong_types(whole: Column) -> Column:
    """Fields of a parsed pack that are there but hold another kind of value than they must."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(whole, f"$.{path}", "variant"))
    texts = [_issue(p, "wrong type", ~kind(p).rlike("^(STRING|VOID)")) for p in TEXTS]
    return _all(*texts, *[_issue(p, "wrong type", ~kind(p).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|VOID)")) for p in NUMBERS])


def fingerprint(tags: Column) -> Column:
    """A map as text: name=value in order of the names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")


def _frame(f: Column) -> Column:
    """An anatomical frame: axes at right angles and right-handed, valves with two borders and tags of their own, claims that fit what they sum up."""
    at = "meshes.anatomical_frame"
    basis, valves = f["basis_source_to_pack"], f["valve_identification"]
    left, basal, front = (basis[n] for n in ("patient_left", "basal", "anterior"))
    cross = F.array(*[F.get(left, F.lit((k + 1) % 3)) * F.get(basal, F.lit((k + 2) % 3)) - F.get(left, F.lit((k + 2) % 3)) * F.get(basal, F.lit((k + 1) % 3)) for k in range(3)])
    tags = F.map_from_entries(F.transform(F.map_entries(valves["valves"]), lambda e: F.struct(e["key"].alias("key"), e["value"]["tag"].alias("value"))))
    agrees = fingerprint(tags) == fingerprint(valves["published_tags"])
    values, passed = F.map_values(valves["valves"]), F.size(F.filter(F.map_values(f["checks"]), lambda c: c))
    return _all(
        *[_issue(f"{at}.basis_source_to_pack.{n}", "not a unit vector", f.isNotNull() & _not_unit(basis[n])) for n in ("patient_left", "basal", "anterior")],
        *[_issue(f"{at}.basis_source_to_pack", "axes not at right angles", F.abs(_dot(a, b)) > UNIT_SLACK) for a, b in ((left, basal), (basal, front), (front, left))],
        _issue(f"{at}.basis_source_to_pack", "not right-handed", _dot(cross, front) <= 0),
        _issue(f"{at}.valve_identification.agrees_with_published", "claim and maps disagree", valves["agrees_with_published"] != agrees),
        _issue(f"{at}.valve_identification.valves", "not two borders", F.exists(values, lambda v: F.size(v["borders"]) != 2)),
        _issue(f"{at}.valve_identification.valves", "tags repeat", F.size(F.array_distinct(F.transform(values, lambda v: v["tag"]))) != F.size(values)),
        _issue(f"{at}.checks_passed", "counts and checks disagree", (F.size(f["checks"]) != f["checks_total"]) | (passed != f["checks_passed"])),
    )


def draft_views(packs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, n_views, n_draft: how many views of each pack are drafts; bodies that are no JSON object have no row, no views are 0."""
    views = F.from_json(body, f"views array<struct<provenance:{_PROVENANCE}>>")["views"]
    known = packs.where(F.json_object_keys(body).isNotNull()).select(key, F.coalesce(views, F.array().cast(f"array<struct<provenance:{_PROVENANCE}>>")).alias("v"))
    return known.select(key, F.size("v").alias("n_views"), F.size(F.filter("v", lambda v: v["provenance"]["vetted"]["status"] == "draft")).alias("n_draft"))


def pack_issues(packs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, path, issue, severity for every finding in ``packs(key, body)``; sound packs have none.

    A pack that is no JSON object has that one finding, and one of another version has only
    that, as its shape is not known. A volume that is absent is "skipped", said aloud. Null
    bodies are no JSON. Repeated rows are reported once each; empty input gives no rows.
    """
    base = packs.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body"))
    # what many checks read is a column, as an expression is worked out anew wherever it stands in another
    base = base.withColumn("keys", F.json_object_keys("body")).withColumn("whole", F.try_parse_json("body"))
    base = base.select("key", "keys", "whole", schema_version(F.col("whole")).alias("version"), F.from_json("body", SCHEMA).alias("p"), F.from_json("body", FRAME)["meshes"]["anatomical_frame"].alias("frame"))
    p, whole = F.col("p"), F.col("whole")
    structures, labels, views = p["meshes"]["structures"], p["echo_volume"]["labels"], p["views"]
    lists = {"known": (structures, "id"), "parents": (structures, "parent"), "nodes": (structures, "mesh_node"), "label_ids": (labels, "id"), "view_ids": (views, "view_id")}
    base = base.select("*", *[F.coalesce(F.transform(items, lambda x: x[field].cast("string")), F.array().cast("array<string>")).alias(name) for name, (items, field) in lists.items()])
    known = F.col("known")
    listed = lambda place, level, check=None: _each(F.try_variant_get(whole, f"$.{place}", "array<variant>"), place, lambda x, at, i: _all(_issue(at, "unknown key", _unknown(_keys(x), level)), *(check(x, at) if check else [])))
    label = lambda x, at, i: _all(
        _issue(F.concat(at, F.lit(".id")), "out of range", ~F.coalesce(x["id"].between(0, 255), F.lit(False))),
        _issue(F.concat(at, F.lit(".echogenicity")), "out of range", ~F.coalesce(x["echogenicity"].between(0, 1), F.lit(False))),
        _issue(F.concat(at, F.lit(".attenuation")), "out of range", ~F.coalesce(x["attenuation"] >= 0, F.lit(False))),
        _issue(F.concat(at, F.lit(".structure")), "unknown structure", ~F.array_contains(known, x["structure"])),
    )
    shape = _all(
        _issue("<root>", "unknown key", _unknown(F.col("keys"), "")),
        *[_issue(place, "unknown key", _unknown(_keys(whole, place), level)) for place, level in PLACES.items()],
        _wrong_types(whole),
        listed("meshes.structures", "structure"),
        listed("echo_volume.labels", "label"),
        listed("views", "view", lambda v, at: [_issue(F.concat(at, F.lit(f".{place}")), "unknown key", _unknown(_keys(v, place), level)) for place, level in VIEW_PLACES.items()]),
        _frame(F.col("frame")),
        *[_issue(f"meta.{f}", "missing", _missing(p["meta"][f])) for f in ("id", "display_name", "anatomy", "canonical_variant", "pack_version")],
        _issue("meshes.gltf", "bad path", text.path_problem(F.coalesce(p["meshes"]["gltf"], F.lit(""))).isNotNull()),
        _issue("meshes.units", "not a unit", ~F.coalesce(p["meshes"]["units"].isin("mm", "cm", "m"), F.lit(False))),
        _issue("meshes.structures", "empty", F.coalesce(F.size(structures), F.lit(0)) <= 0),
        _issue("meshes.canonical_pose.scale", "out of range", ~F.coalesce(p["meshes"]["canonical_pose"]["scale"] > 0, F.lit(False)) & ~F.coalesce(F.schema_of_variant(F.try_variant_get("whole", "$.meshes.canonical_pose.scale", "variant")) == "STRING", F.lit(False))),
        _orientation(p["meshes"]["orientation"]),
        _structures(structures, known, F.col("parents")),
        _repeats(known, "meshes.structures", "id"),
        _repeats(F.col("nodes"), "meshes.structures", "mesh_node"),
        _camera(p["interaction"]["camera"]),
        _issue("interaction.free_cut.normal", "not a unit vector", p["interaction"]["free_cut"].isNotNull() & _not_unit(p["interaction"]["free_cut"]["normal"])),
        _issue("echo_volume", "absent", p["echo_volume"].isNull(), "skipped"),
        _issue("echo_volume.asset", "bad path", p["echo_volume"].isNotNull() & text.path_problem(F.coalesce(p["echo_volume"]["asset"], F.lit(""))).isNotNull()),
        _each(labels, "echo_volume.labels", label),
        _repeats(F.col("label_ids"), "echo_volume.labels", "id"),
        _issue("views", "empty", F.coalesce(F.size(views), F.lit(0)) <= 0),
        _views(views, known),
        _repeats(F.col("view_ids"), "views", "view_id"),
        _provenance(p["provenance"], "provenance"),
    )
    not_json = F.col("keys").isNull()
    other = ~F.coalesce(F.col("version") == VERSION, F.lit(False))
    found = F.when(not_json, _issue("<root>", "not a JSON object", F.lit(True))).when(other, _issue("meta.schema_version", "not the known version", F.lit(True))).otherwise(shape)
    # found is a column of its own, as what stands inside explode() is interpreted; an inner explode() of it would be filtered before, which works it out twice
    return base.select("key", found.alias("found")).select("key", F.explode_outer("found").alias("f")).where("f is not null").select(F.col("key").alias(key), "f.path", "f.issue", "f.severity")
