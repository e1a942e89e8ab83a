"""Member resolution from scanned codes."""

from __future__ import annotations

from kitlend.operators.members import resolve_members
from kitlend.plans.catalog import register
from kitlend.plans.oracle_fixtures import with_fixtures
from kitlend.sources import fixtures as fx

_B = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{_B}+|-', '', 'g')"


def _uuid_or_strip(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_UUID}') THEN {x} ELSE {_strip(x)} END"


RESOLVE_CTES = {
    "_n1": f"""
  SELECT scan_id, raw, {_trim("coalesce(raw, '')")} AS s0 FROM scan_codes""",
    "_n2": """
  SELECT *, coalesce(TRY(url_decode(s0)), s0) AS s FROM _n1""",
    "_n3": r"""
  SELECT *, regexp_matches(s, '(?i)^https?://') AS is_link,
         regexp_extract(s, '^[^?#]*\?(?:[^#]*&)?member=([^&#]*)', 1) AS member_raw,
         regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM _n2""",
    "_n4": f"""
  SELECT *,
         {_trim("coalesce(TRY(url_decode(replace(member_raw, '+', ' '))), member_raw)")} AS member,
         {_trim("coalesce(list_filter(string_split(path, '/'), lambda x: x <> '')[-1], '')")} AS last_seg,
         {_strip("s")} AS stripped
  FROM _n3""",
    "_codes": rf"""
  SELECT scan_id, raw,
         CASE WHEN is_link AND member <> '' THEN {_uuid_or_strip("member")}
              WHEN is_link AND last_seg <> '' THEN {_uuid_or_strip("last_seg")}
              WHEN regexp_matches(s, '{_UUID}') THEN s
              WHEN regexp_extract(stripped, '\b([0-9]{{13}})\b', 1) <> ''
                THEN regexp_extract(stripped, '\b([0-9]{{13}})\b', 1)
              WHEN regexp_extract(stripped, '\b([0-9]{{12}})\b', 1) <> ''
                THEN regexp_extract(stripped, '\b([0-9]{{12}})\b', 1)
              ELSE stripped END AS code
  FROM _n4""",
    "_keys": """
  SELECT CAST(id AS VARCHAR) AS key, 1 AS rank, id AS user_id FROM users
  UNION ALL SELECT qr_code_value, 2, id FROM users WHERE qr_code_value <> ''
  UNION ALL SELECT student_id, 3, id FROM users WHERE student_id <> ''
  UNION ALL SELECT citizen_id, 4, id FROM users WHERE citizen_id <> ''
  UNION ALL SELECT student_id_hash, 5, id FROM users WHERE student_id_hash <> ''""",
    "_hits": """
  SELECT c.scan_id, k.rank, k.user_id,
         row_number() OVER (PARTITION BY c.scan_id ORDER BY k.rank, k.user_id) AS rn
  FROM _codes c JOIN _keys k
    ON (k.rank < 5 AND k.key = c.code) OR (k.rank = 5 AND k.key = sha256(c.code))
  WHERE c.code <> ''""",
}

RESOLVE_SQL = with_fixtures("""
SELECT c.scan_id, c.raw, c.code, h.user_id,
       CASE h.rank WHEN 1 THEN 'id' WHEN 2 THEN 'qr_code_value' WHEN 3 THEN 'student_id'
                   WHEN 4 THEN 'citizen_id' WHEN 5 THEN 'student_id_hash' END AS matched_by,
       u.full_name, u.member_type
FROM _codes c LEFT JOIN _hits h ON h.scan_id = c.scan_id AND h.rn = 1
LEFT JOIN users u ON u.id = h.user_id""", RESOLVE_CTES)


@register("resolve_members", RESOLVE_SQL)
def q_resolve_members(spark, sf_dir):
    return resolve_members(fx.scan_codes(spark, sf_dir), fx.users(spark, sf_dir))
