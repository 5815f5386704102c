"""SQL fragments shared by the DuckDB twins."""

# White space trimmed at both ends.
def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


NL = "chr(10)"


def lines(x: str) -> str:
    return rf"string_split_regex({x}, '\r\n|[\n\r\x0B\f]')"


def total_removed(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)\[Total:\s*\d+\s*\]', '', 'g')"


def bracket_marks(x: str) -> str:
    return rf"""(select case when sum(n) > 0 then least(sum(n), 99)::bigint end
      from (select try_cast(unnest(regexp_extract_all({total_removed(x)}, '\[\s*(\d+)\s*\]', 1)) as bigint) n)
      where n between 1 and 40)"""


def infer_marks(x: str) -> str:
    return rf"""coalesce({bracket_marks(x)},
      case when regexp_extract({x}, '(?i)\[(\d+)\s*mark', 1) <> '' then
        case when regexp_extract({x}, '(?i)\[(\d+)\s*mark', 1)::bigint <= 40
          then greatest(regexp_extract({x}, '(?i)\[(\d+)\s*mark', 1)::bigint, 1) else 1 end end,
      case when regexp_extract({x}, '(?m)\((\d+)\)\s*$', 1) <> '' then
        case when regexp_extract({x}, '(?m)\((\d+)\)\s*$', 1)::bigint between 1 and 20
          then regexp_extract({x}, '(?m)\((\d+)\)\s*$', 1)::bigint else 1 end end,
      1)"""


def strip_marks(x: str) -> str:
    y = total_removed(x)
    y = rf"regexp_replace({y}, '(?i)\[\s*\d+\s*marks?\s*\]', '', 'g')"
    y = rf"regexp_replace({y}, '\[\s*0*(?:[1-9]|[1-3]\d|40)\s*\]', '', 'g')"
    y = rf"regexp_replace({y}, '[ \t]+\n', chr(10), 'g')"
    y = rf"regexp_replace({y}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(y)


def science(x: str) -> str:
    y = f"translate({x}, chr(61620) || chr(61614) || chr(61678) || chr(61623) || '×', 'x→→•x')"
    y = rf"regexp_replace({y}, 'x\s*10\s*[–\-−]\s*(\d+)', 'x 10^-\1', 'g')"
    y = rf"regexp_replace({y}, 'x\s*10\s*(\d+)', 'x 10^\1', 'g')"
    return rf"regexp_replace({y}, 'x\s*10\s*([A-Za-z])($|\s|OR\b|[.,;:])', 'x 10^\1\2', 'g')"


def letter_lines(x: str) -> str:
    return f"list_transform({lines(x)}, lambda s: upper({strip('s')}))"


def has_options(x: str) -> str:
    m = letter_lines(x)
    return f"""(list_contains({m}, 'A')
      and list_contains({m}[list_position({m}, 'A') + 1:], 'B')
      and list_contains({m}[list_position({m}, 'A') + 1:], 'C'))"""


def question_type(x: str) -> str:
    return rf"""case when contains(lower({x}), 'multiple choice')
        or regexp_matches({x}, '(?m)^\s*[A-Da-d]\s{{1,4}}\d') or {has_options(x)} then 'multiple_choice'
      when contains(lower({x}), 'calculate') or contains(lower({x}), 'show your working') then 'calculation'
      when length({x}) > 400 then 'long_answer' else 'short_answer' end"""


def mc_letter(x: str) -> str:
    clean = f"regexp_replace(upper({x}), '[^ABCD]', '', 'g')"
    return f"case when regexp_matches({clean}, '^(A+|B+|C+|D+)$') then left({clean}, 1) else '?' end"


def half_even(x: str, digits: int = 0) -> str:
    """Round to even at exact ties."""
    m = 10 ** digits
    return f"(case when abs(({x}) * {m} - floor(({x}) * {m}) - 0.5) < 1e-12 then 2 * round(({x}) * {m} / 2) / {m} else round(({x}), {digits}) end)"


def band(x: str) -> str:
    return f"case when {x} >= 80 then 'green' when {x} >= 50 then 'yellow' else 'red' end"


def answer_fields(x: str) -> tuple[str, str]:
    """Answer and rest of a stripped answer-key text."""
    first, rest = strip(lines(x) + "[1]"), strip(f"array_to_string({lines(x)}[2:], chr(10))")
    letter = rf"""case when regexp_matches({first}, '^[A-Da-d]$') then upper({first})
      when regexp_matches({first}, '^\d{{1,2}}\s+[A-Da-d]\s*$') then upper(regexp_extract({first}, '([A-Da-d])\s*$', 1))
      when length({first}) <= 4 and regexp_matches({first}, '^[\d\sA-Da-d.]+$') and regexp_matches({first}, '\b[A-Da-d]\b')
        then upper(regexp_extract({first}, '\b([A-Da-d])\b', 1)) end"""
    return f"case when {x} <> '' then coalesce({letter}, nullif({first}, '')) end", f"case when {x} <> '' then nullif({rest}, '') end"


def ratios(pairs: str) -> str:
    """``a, b, ratio`` of distinct pairs ``a, b`` after Ratcliff and Obershelp: the longest common block, then what lies left and right of it.

    Among equally long blocks the first in ``a``, then in ``b`` counts. The query starts with ``with recursive``.
    """
    prefix = "list_max(list_transform(range(0, least(ahi - i, bhi - j) + 1), lambda k: case when substr(a, (i + 1)::int, k::int) = substr(b, (j + 1)::int, k::int) then k else 0 end))"
    best = f"list_sort(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: [{prefix}, -i, -j]))), 'DESC')[1]"
    return f"""with recursive seg as (
      select a, b, {best} as m, alo, ahi, blo, bhi from (select distinct a, b, 0::bigint as alo, length(a)::bigint as ahi, 0::bigint as blo, length(b)::bigint as bhi from ({pairs}))
      union all
      select a, b, {best}, alo, ahi, blo, bhi from (
        select a, b, u.alo as alo, u.ahi as ahi, u.blo as blo, u.bhi as bhi from (select a, b, unnest([
          {{'alo': alo, 'ahi': -m[2], 'blo': blo, 'bhi': -m[3]}}, {{'alo': m[1] - m[2], 'ahi': ahi, 'blo': m[1] - m[3], 'bhi': bhi}}]) as u from seg where m[1] > 0)) where alo < ahi and blo < bhi)
    select a, b, 2.0::double * sum(m[1]) / (length(a) + length(b)) as ratio from seg group by a, b"""
