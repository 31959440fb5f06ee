"""Packs made of parts: a document for each row of part, its texts, numbers and faults from the row's columns.

The document is one concatenation that Spark and the SQL twin read alike; the twin then looks
for every finding with JSON functions of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import packs

_K = lambda mod, rest: f"p_partkey % {mod} = {rest}"
_IF = lambda test, a, b: f"CASE WHEN {test} THEN '{a}' ELSE '{b}' END"
_S = lambda expr: f"CAST({expr} AS STRING)"


def _text(template: str, **parts: str) -> str:
    """A concat() of the template's text, with an SQL expression for each <name>."""
    pieces = []
    for k, piece in enumerate(template.replace(">", "<").split("<")):
        pieces.append(parts[piece] if k % 2 else f"'{piece}'")
    return f"concat({', '.join(pieces)})"


_PACK_SOURCE = _text(
    '{"creator":"<creator>","source":"Catalogue of parts","source_url":"<url>","license":"ODbL-1.0","license_url":"https://licence.test/odbl","modified":{"flag":<changed>,"note":""},"derivation_chain":[<chain>],"vetted":{"status":"<status>","vetters":[],"last_reviewed":null}}',
    creator=f"CASE WHEN {_K(31, 4)} THEN 'TBD: who made it' ELSE p_brand END", url=f"concat('{{}}', {_S('p_partkey')})".replace("'{}'", _IF(_K(23, 6), "ftp://parts.test/", "https://parts.test/")),
    changed=_IF(_K(19, 7), "true", "false"), chain=_IF(_K(43, 8), "", '"catalogue","row"'), status=_IF(_K(17, 9), "vetted", "draft"),
)
_VIEW_SOURCE = _text(
    '{"creator":"<creator>","source":"Measured on the part","source_url":"https://views.test/how","license":"ODbL-1.0","license_url":"https://licence.test/odbl","modified":{"flag":false,"note":""},"derivation_chain":["part"],"vetted":{"status":"draft","vetters":[],"last_reviewed":null}}',
    creator=_IF(_K(131, 29), "", "The gauge"),
)
_STRUCTURES = _text(
    '{"id":"w0","mesh_node":"node 0","display_label":"Body of <name>","parent":<first>,"blood_pool":false,"stylized":false},{"id":"w1","mesh_node":"<node>","display_label":"Rim","parent":"<second>","blood_pool":true,"stylized":false<colour>}<third>',
    name="p_name", first=_IF(_K(13, 10), '"w1"', "null"), node=_IF(_K(47, 11), "node 0", "node 1"), second=_IF(_K(11, 3), "nobody", "w0"), colour=_IF(_K(53, 13), ',"colour":"grey"', ""),
    third=f"CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(',{{\"id\":\"', {_IF(_K(41, 12), 'w1', 'w2')}, '\",\"mesh_node\":\"node 2\",\"display_label\":\"Hub\",\"parent\":\"w0\",\"blood_pool\":false,\"stylized\":true}}') END",
)
_FRAME = _text(
    ',"anatomical_frame":{"method":"ends","description":"Ends of a part","inputs":{},"valve_identification":{"method":"faces","description":"Shared faces","chamber_tags":{"body":1},"valves":{"inlet":{"tag":7,"borders":{"1":3,"3":4}},"outlet":{"tag":<tag>,"borders":{"1":2<more>}}},"published_tags":{"outlet":9,"inlet":7},"agrees_with_published":<agrees>},"landmarks_source_mm":{},"basis_source_to_pack":{"patient_left":[1,0,0],"basal":<basal>,"anterior":[0,0,<front>]},"measurements":{},"checks":{"above":true,"left":<left>},"checks_passed":<passed>,"checks_total":2}',
    tag=f"CASE WHEN p_size % 9 = 0 THEN '7' WHEN p_size % 9 = 1 THEN '8' ELSE '9' END", more=_IF("p_size % 11 = 0", "", ',"5":6'), agrees=_IF("p_size % 4 = 0", "false", "true"), basal=_IF(_K(4, 0), "[0.6,0.8,0]", "[0,1,0]"),
    front=_IF("p_size % 7 = 0", "-1", "1"), left=_IF("p_size % 2 = 0", "true", "false"), passed=_IF("p_size % 3 = 0", "2", "1"),
)
_AXES = ("+x", "-x", "+y", "-y", "+z", "-z")
_LEFT = f"CASE p_partkey % 6 {' '.join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(_AXES))} END"
_VOLUME = _text(
    ',"echo_volume":{"asset":"<folder>v-<key>.raw","format":"raw-u8","resolution":[8,8,8],"mesh_to_volume":[1,0,0,0,0,1,0,0,0,0,1,0,4,4,4,1],"labels":[{"id":<one>,"structure":"w0","echogenicity":<echo>,"attenuation":<weak>},{"id":<two>,"structure":"<of>","echogenicity":0.25,"attenuation":0}],"scatterer_seed":7}',
    folder=_IF(_K(83, 20), "../", "volumes/"), key=_S("p_partkey"), one=_S("p_size * 6"), two=f"CASE WHEN {_K(89, 21)} THEN {_S('p_size * 6')} ELSE '3' END", of=_IF(_K(97, 22), "lid", "w1"),
    echo=f"CASE WHEN p_size % 12 = 11 THEN '1.5' ELSE concat('0.', {_S('p_size % 12')}) END", weak=_IF("p_size % 10 = 9", "-1", "0.5"),
)
_VIEW = lambda name: _text(
    '{"family":"A","view_id":"<id>","name":"View","aliases":[],"placement_landmark":"rim","indicator_clock":"<clock>:30","probe":{"origin":[0,0,9],"beam_axis":[0,0,<beam>],"lateral_axis":<lateral>,"fan":{"angle_deg":<angle>,"depth_cm":12,"focus_cm":<focus>},"display":{"vertex":"up","marker_side":"left","flip_lr":false}<gain>},"sweep":{"mode":"<mode>","axis":{"direction":[0,1,0]},"range":{"unit":"<unit>","from":<low>,"to":<high>},"interpolation":"lerp","structures_in_order":["w0",<order>"w1"]},"structures":["w0","w1"],"measurements":[],"lesion_attachments":[],"show_hide_preset":{"visible":["w0"],"hidden":[<hidden>"w1"]},"echo_tuning":{},"real_clip_slot":null,"emphasis":null,"provenance":<source>}',
    id=name, clock=_S("p_size % 14"), beam=_IF(_K(107, 25), "-2", "-1"), lateral=_IF(_K(103, 24), "[0,0,1]", "[1,0,0]"), angle=_S("p_size * 4"), focus=_S("p_size % 15"), gain=_IF(_K(127, 28), ',"gain":3', ""), mode=_IF("p_size % 2 = 0", "translate", "tilt"),
    unit=_IF("p_size % 4 = 0", "mm", "deg"), low=_S("p_size % 5"), high=_S("p_size % 3"), order=_IF(_K(109, 26), '"ghost",', ""), hidden=_IF(_K(113, 27), '"w0",', ""), source=_VIEW_SOURCE,
)
BODY = _text(
    '<open>"meta":{"id":"part-<key>","display_name":<name>,"anatomy":"<type>","canonical_variant":"<brand>","pack_version":"<size>.0","schema_version":<version>},"provenance":<source>,"meshes":{"gltf":"scenes/part.gltf","structures":[<structures>],"canonical_pose":{"position":[<size>,0,0],"rotation_euler_xyz_deg":[0,90,0],"scale":<scale>},"units":"<units>","orientation":{"up":"+z","anterior":"-y","patient_left":"<left>","handedness":"<hand>"}<frame>},"interaction":{"pivot":[0,<size>,0],"camera":{"position":[<size>,0,10],"target":[<size>,0,<near>],"up":<up>,"fov_deg":<fov>},"free_cut":{"normal":[0,0,<normal>],"offset":<size>}}<volume>,"views":[<views>],"display_flags":{},"volumetric_data":null}',
    open=f"CASE WHEN {_K(137, 30)} THEN '' WHEN {_K(151, 33)} THEN '{{\"extra\":1,' ELSE '{{' END", key=_S("p_partkey"), name=f"CASE WHEN {_K(29, 5)} THEN '\"\"' WHEN {_K(139, 31)} THEN '5' ELSE concat('\"', p_name, '\"') END", type="p_type", brand="p_brand", size=_S("p_size"),
    version=f"CASE p_partkey % 37 WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN '\"7\"' ELSE '\"0\"' END", source=_PACK_SOURCE, structures=_STRUCTURES, scale=f"CASE WHEN {_K(59, 14)} THEN '0' WHEN {_K(149, 32)} THEN '\"2\"' ELSE {_S('p_size')} END", units=_IF(_K(61, 15), "inch", "mm"),
    left=_LEFT, hand=_IF("p_size % 2 = 0", "left", "right"), frame=f"CASE WHEN p_partkey % 2 = 0 THEN {_FRAME} ELSE '' END", near=_IF(_K(67, 16), "10", "0"), up=_IF(_K(71, 17), "[0,0,1]", "[0,1,0]"), fov=_S("p_size * 4"), normal=_IF(_K(73, 18), "2", "1"),
    volume=f"CASE WHEN {_K(79, 19)} THEN '' ELSE {_VOLUME} END", views="concat({}, CASE WHEN p_partkey % 2 = 0 THEN concat(',', {}) ELSE '' END)".format(_VIEW("'v0'"), _VIEW(_IF(_K(101, 23), "v0", "v1"))),
)


def documents(spark, sf_dir) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    # a row of a few bytes becomes a document that takes milliseconds to check, so rows are spread before
    return parts.repartition(spark.sparkContext.defaultParallelism).select("p_partkey", F.expr(BODY).alias("body"))


def pack_validation(spark, sf_dir):
    """Findings in a pack for each part."""
    return packs.pack_issues(documents(spark, sf_dir), "p_partkey")


def draft_views(spark, sf_dir):
    """Views of each pack that nobody has vetted yet."""
    return packs.draft_views(documents(spark, sf_dir), "p_partkey")


DOCS = f"WITH docs AS (SELECT p_partkey, {BODY} AS body FROM part), ok AS (SELECT p_partkey, body::JSON AS j FROM docs WHERE json_valid(body))"
_LIST = lambda keys: "[" + ", ".join(f"'{k}'" for k in keys) + "]"
_ODD = lambda j, level: f"len(list_filter(json_keys({j}), lambda key: NOT list_contains({_LIST(packs.KEYS[level])}, key))) > 0"
_NUM = lambda j, path: f"json_extract({j}, '$.{path}')::DOUBLE"
_STR = lambda j, path: f"json_extract_string({j}, '$.{path}')"
_V3 = lambda j, path: [_NUM(j, f"{path}[{k}]") for k in range(3)]
_D = lambda a, b: "(" + " + ".join(f"{p}*{q}" for p, q in zip(a, b, strict=True)) + ")"
_BEAM, _SIDE = _V3("v", "probe.beam_axis"), _V3("v", "probe.lateral_axis")
_BAD = lambda a: f"abs(sqrt({_D(a, a)}) - 1) > 1e-3"
_AX = {a: tuple((1 if a[0] == "+" else -1) * (a[1] == x) for x in "xyz") for a in _AXES}
_SIGN = f"CASE json_extract_string(j, '$.meshes.orientation.patient_left') {' '.join(f"WHEN '{a}' THEN {v[0] * -1 * -1}" for a, v in _AX.items())} END"
_PLACEHOLDER = lambda e: f"regexp_matches(lower({e}), '^(tbd|todo|fixme|unknown|n/a|na|xxx|placeholder|\\?\\?\\?)([\\s:;,._-]|$)')"
_FR = "meshes.anatomical_frame"
#: Path, issue and when it is found; the rows are packs, structures, labels or views of packs of the known version.
_PACK_RULES = [
    ("'meta.schema_version'", "wrong type", "json_type(j, '$.meta.schema_version') <> 'VARCHAR'"),
    ("'meta.display_name'", "missing", f"{_STR('j', 'meta.display_name')} = ''"),
    ("'meta.display_name'", "wrong type", "json_type(j, '$.meta.display_name') <> 'VARCHAR'"),
    ("'meshes.canonical_pose.scale'", "wrong type", "json_type(j, '$.meshes.canonical_pose.scale') = 'VARCHAR'"),
    ("'meshes.canonical_pose.scale'", "out of range", f"json_type(j, '$.meshes.canonical_pose.scale') <> 'VARCHAR' AND {_NUM('j', 'meshes.canonical_pose.scale')} <= 0"),
    ("'<root>'", "unknown key", _ODD("j", "")),
    ("'provenance.creator'", "placeholder", _PLACEHOLDER(_STR("j", "provenance.creator"))),
    ("'provenance.source_url'", "not http", f"NOT regexp_matches({_STR('j', 'provenance.source_url')}, '^https?://.')"),
    ("'provenance.modified.note'", "changes without a note", f"{_STR('j', 'provenance.modified.flag')} = 'true' AND trim({_STR('j', 'provenance.modified.note')}) = ''"),
    ("'provenance.derivation_chain'", "empty", "json_array_length(j, '$.provenance.derivation_chain') = 0"),
    ("'provenance.vetted.vetters'", "vetted by nobody", f"{_STR('j', 'provenance.vetted.status')} = 'vetted' AND json_array_length(j, '$.provenance.vetted.vetters') = 0"),
    ("'provenance.vetted.last_reviewed'", "vetted without a date", f"{_STR('j', 'provenance.vetted.status')} = 'vetted' AND {_STR('j', 'provenance.vetted.last_reviewed')} IS NULL"),
    ("'meshes.units'", "not a unit", f"{_STR('j', 'meshes.units')} NOT IN ('mm', 'cm', 'm')"),
    ("'meshes.orientation'", "axes repeat", f"{_SIGN} = 0"),
    # up is +z and anterior -y, so the determinant is the left axis' x
    ("'meshes.orientation.handedness'", "does not fit the axes", f"{_SIGN} <> 0 AND {_SIGN} <> CASE {_STR('j', 'meshes.orientation.handedness')} WHEN 'right' THEN 1 ELSE -1 END"),
    ("'interaction.camera.target'", "camera at its target", " AND ".join(f"{a} = {b}" for a, b in zip(_V3("j", "interaction.camera.position"), _V3("j", "interaction.camera.target"), strict=True))),
    ("'interaction.camera.up'", "up along the view", f"{_NUM('j', 'interaction.camera.target[2]')} <> 10 AND {_NUM('j', 'interaction.camera.up[2]')} = 1"),
    ("'interaction.camera.fov_deg'", "out of range", f"NOT {_NUM('j', 'interaction.camera.fov_deg')} BETWEEN 1e-9 AND 179"),
    ("'interaction.free_cut.normal'", "not a unit vector", _BAD(_V3("j", "interaction.free_cut.normal"))),
    ("'echo_volume'", "absent", "json_extract(j, '$.echo_volume') IS NULL"),
    ("'echo_volume.asset'", "bad path", f"{_STR('j', 'echo_volume.asset')} LIKE '../%'"),
    (f"'{_FR}.basis_source_to_pack'", "axes not at right angles", f"abs({_D(_V3('j', _FR + '.basis_source_to_pack.patient_left'), _V3('j', _FR + '.basis_source_to_pack.basal'))}) > 1e-3"),
    # left is x and basal has no third part, so their cross product runs along z by the basal's y
    (f"'{_FR}.basis_source_to_pack'", "not right-handed", f"{_NUM('j', _FR + '.basis_source_to_pack.basal[1]')} * {_NUM('j', _FR + '.basis_source_to_pack.anterior[2]')} <= 0"),
    (f"'{_FR}.valve_identification.agrees_with_published'", "claim and maps disagree", f"({_STR('j', _FR + '.valve_identification.agrees_with_published')} = 'true') <> (json_extract(j, '$.{_FR}.valve_identification.valves.inlet.tag') = json_extract(j, '$.{_FR}.valve_identification.published_tags.inlet') AND json_extract(j, '$.{_FR}.valve_identification.valves.outlet.tag') = json_extract(j, '$.{_FR}.valve_identification.published_tags.outlet'))"),
    (f"'{_FR}.valve_identification.valves'", "not two borders", f"len(json_keys(j, '$.{_FR}.valve_identification.valves.inlet.borders')) <> 2 OR len(json_keys(j, '$.{_FR}.valve_identification.valves.outlet.borders')) <> 2"),
    (f"'{_FR}.valve_identification.valves'", "tags repeat", f"json_extract(j, '$.{_FR}.valve_identification.valves.inlet.tag') = json_extract(j, '$.{_FR}.valve_identification.valves.outlet.tag')"),
    (f"'{_FR}.checks_passed'", "counts and checks disagree", f"len(json_keys(j, '$.{_FR}.checks')) <> {_NUM('j', _FR + '.checks_total')} OR len(list_filter(json_keys(j, '$.{_FR}.checks'), lambda n: json_extract_string(j, '$.{_FR}.checks.' || n) = 'true')) <> {_NUM('j', _FR + '.checks_passed')}"),
]
_AT = lambda head, tail: f"'{head}.' || i || '{tail}'"
_STRUCTURE_RULES = [
    ("", "unknown key", _ODD("v", "structure")),
    (".id", "repeated", "list_position(ids, v->>'id') < i + 1"),
    (".mesh_node", "repeated", "list_position(nodes, v->>'mesh_node') < i + 1"),
    (".parent", "unknown structure", "v->>'parent' IS NOT NULL AND NOT list_contains(ids, v->>'parent')"),
]
_LABEL_RULES = [
    (".id", "out of range", f"NOT {_NUM('v', 'id')} BETWEEN 0 AND 255"), (".id", "repeated", "list_position(lids, v->>'id') < i + 1"), (".echogenicity", "out of range", f"NOT {_NUM('v', 'echogenicity')} BETWEEN 0 AND 1"),
    (".attenuation", "out of range", f"{_NUM('v', 'attenuation')} < 0"), (".structure", "unknown structure", "NOT list_contains(ids, v->>'structure')"),
]
_VIEW_RULES = [
    (".view_id", "repeated", "list_position(vids, v->>'view_id') < i + 1"), (".indicator_clock", "not a clock", "NOT regexp_matches(v->>'indicator_clock', '^(1[0-2]|[1-9]):[0-5][0-9]$')"),
    (".probe", "unknown key", _ODD("json_extract(v, '$.probe')", "probe")), (".probe.beam_axis", "not a unit vector", _BAD(_BEAM)), (".probe.lateral_axis", "not across the beam", f"NOT {_BAD(_BEAM)} AND abs({_D(_BEAM, _SIDE)}) > 1e-3"),
    (".probe.fan.angle_deg", "out of range", f"NOT {_NUM('v', 'probe.fan.angle_deg')} BETWEEN 1e-9 AND 180"), (".probe.fan.focus_cm", "focus below the depth", f"{_NUM('v', 'probe.fan.focus_cm')} > {_NUM('v', 'probe.fan.depth_cm')}"),
    (".sweep.range.unit", "wrong unit", f"{_STR('v', 'sweep.range.unit')} <> CASE {_STR('v', 'sweep.mode')} WHEN 'translate' THEN 'mm' ELSE 'deg' END"), (".sweep.range", "no extent", f"{_NUM('v', 'sweep.range.from')} = {_NUM('v', 'sweep.range.to')}"),
    (".sweep.structures_in_order.1", "unknown structure", f"NOT list_contains(ids, {_STR('v', 'sweep.structures_in_order[1]')})"), (".show_hide_preset", "shown and hidden", f"{_STR('v', 'show_hide_preset.hidden[0]')} = {_STR('v', 'show_hide_preset.visible[0]')}"),
    (".provenance.creator", "missing", f"{_STR('v', 'provenance.creator')} = ''"),
]
_UNDER = lambda path: f"(SELECT p_partkey, ids, nodes, lids, vids, i, json_extract(j, '$.{path}[' || i || ']') AS v FROM (SELECT *, unnest(range(json_array_length(j, '$.{path}')::BIGINT)) AS i FROM known WHERE json_extract(j, '$.{path}') IS NOT NULL))"
_SELECTS = [f"SELECT p_partkey, {p} AS path, '{issue}' AS issue FROM known WHERE {test}" for p, issue, test in _PACK_RULES]
for _path, _rules in (("meshes.structures", _STRUCTURE_RULES), ("echo_volume.labels", _LABEL_RULES), ("views", _VIEW_RULES)):
    _SELECTS += [f"SELECT p_partkey, {_AT(_path, tail)}, '{issue}' FROM {_UNDER(_path)} WHERE {test}" for tail, issue, test in _rules]
VALIDATION = f"""{DOCS}, ver AS (SELECT *, json_extract_string(j, '$.meta.schema_version') AS version FROM ok),
known AS (SELECT *, list_transform(range(json_array_length(j, '$.meshes.structures')::BIGINT), lambda n: json_extract_string(j, '$.meshes.structures[' || n || '].id')) AS ids, list_transform(range(json_array_length(j, '$.meshes.structures')::BIGINT), lambda n: json_extract_string(j, '$.meshes.structures[' || n || '].mesh_node')) AS nodes,
 list_transform(range(coalesce(json_array_length(j, '$.echo_volume.labels'), 0)::BIGINT), lambda n: json_extract_string(j, '$.echo_volume.labels[' || n || '].id')) AS lids, list_transform(range(json_array_length(j, '$.views')::BIGINT), lambda n: json_extract_string(j, '$.views[' || n || '].view_id')) AS vids FROM ver WHERE version = '0'),
st AS (SELECT p_partkey, i, v->>'id' AS id, v->>'parent' AS parent FROM {_UNDER("meshes.structures")}),
first_of AS (SELECT p_partkey, id, arg_min(parent, i) AS parent FROM (SELECT p_partkey, id, i, coalesce(parent, '') AS parent FROM st) GROUP BY 1, 2),
w0 AS (SELECT p_partkey, i, parent AS up FROM st), w1 AS (SELECT w.p_partkey, w.i, f.parent AS up FROM w0 w JOIN first_of f ON f.p_partkey = w.p_partkey AND f.id = w.up), w2 AS (SELECT w.p_partkey, w.i, f.parent AS up FROM w1 w JOIN first_of f ON f.p_partkey = w.p_partkey AND f.id = w.up), w3 AS (SELECT w.p_partkey, w.i, f.parent AS up FROM w2 w JOIN first_of f ON f.p_partkey = w.p_partkey AND f.id = w.up),
found AS ({" UNION ALL ".join(_SELECTS)} UNION ALL SELECT p_partkey, 'meshes.structures.' || i || '.parent', 'cycle' FROM w3 WHERE up <> '' AND (p_partkey, up) IN (SELECT (p_partkey, id) FROM st)
 UNION ALL SELECT p_partkey, '<root>', 'not a JSON object' FROM docs WHERE NOT json_valid(body) UNION ALL SELECT p_partkey, 'meta.schema_version', 'not the known version' FROM ver WHERE version IS NULL OR version <> '0')
SELECT p_partkey, path, issue, CASE WHEN issue = 'absent' THEN 'skipped' ELSE 'failure' END AS severity FROM found"""
DRAFTS = f"{DOCS} SELECT p_partkey, json_array_length(j, '$.views')::INT AS n_views, len(list_filter(range(json_array_length(j, '$.views')::BIGINT), lambda n: json_extract_string(j, '$.views[' || n || '].provenance.vetted.status') = 'draft'))::INT AS n_draft FROM ok"

QUERIES = {f.__name__: f for f in (pack_validation, draft_views)}
ORACLES = {"pack_validation": VALIDATION, "draft_views": DRAFTS}
