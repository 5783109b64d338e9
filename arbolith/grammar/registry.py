"""Grammars that come with the package, by name; and parsing tables of texts by a grammar."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Node, document
from ..sources.readers import tree_rows
from .earley import Failure, Machine, failure_document, kept_characters
from .front import parse

#: Element names and the shapes of trees are those that users of these grammars know.


def _separated(sep: str, quotes: bool) -> str:
    """Rows of cells; with ``quotes`` a cell may be quoted, with doubled quotes in it. A row holds a separator or something else."""
    plain = f"~[{sep}; #a; #d]+" if not quotes else f"~[{sep}; #22; #a; #d], ~[{sep}; #a; #d]*"
    more = "| -#22, (~[#22] | -#22, #22)*, -#22" if quotes else ""
    return f"""
table = -end*, tr++-end, -end*.
tr = some>td | td, -{sep}, td++-{sep}.
some = {plain} {more}.
td = ({plain} {more})?.
end = -#d?, -#a.
"""


def _yaml(levels: int = 5) -> str:
    """Maps and lists by an indentation of two spaces, down to ``levels`` of them: a rule of each kind for each level."""
    rules = ["_ = block0.", "key = [L; '_'], [L; N; '-_']*.", "A = .", "-end = -#a+.", "-value = quoted | single | plain."]
    rules += ["-plain = ~['\"'; \"'\"; #a; '-'], (~[':#'; \"'\"; #a] | ':', ~[' '; #a])* | '-', ~[' '; #a], (~[':#'; #a] | ':', ~[' '; #a])*."]
    rules += ["-single = -\"'\", ~[\"'\"; #a]*, -\"'\".", "-quoted = -'\"', (~['\"\\'; #a] | -'\\', ['\\nrtbf\"'])*, -'\"'."]
    for n in range(levels):
        ind, last = f"-'{'  ' * n}', " if n else "", n == levels - 1
        below = "" if last else f", block{n + 1}?"
        rules.append(f"-block{n} = (kv{n} | obj{n})+ | list{n}.")
        rules.append(f"kv{n}>kv = {ind}@key, -': ', value, end.")
        rules.append(f"obj{n}>obj = {ind}@key, -':', end{below}.")
        rules.append(f"list{n}>list = @A, li{n}+.")
        nested = "" if last else f" | first{n + 1}, (kv{n + 1} | obj{n + 1})*"
        rules.append(f"li{n}>li = {ind}-'- ', (value, end{nested}).")
        rules.append(f"-first{n} = kvhere | here{n}.")
        rules.append(f"here{n}>obj = @key, -':', end{below}.")
    rules.append("kvhere>kv = @key, -': ', value, end.")
    return "\n".join(rules)


#: Fixed values of the international code form of weather reports: descriptors and phenomena, and what they say.
DESCRIPTORS = dict(MI="shallow", BC="patches of", PR="partial", DR="low drifting", BL="blowing", SH="showers", TS="thunderstorms", FZ="freezing")
PHENOMENA = dict(
    DZ="drizzle", RA="rain", SN="snow", SG="snow grains", IC="ice crystals", PL="ice pellets", GR="hail", GS="small hail", UP="unknown precipitation",
    BR="mist", FG="fog", FU="smoke", VA="volcanic ash", DU="widespread dust", SA="sand", HZ="haze", PY="spray",
    PO="sand whirls", SQ="squalls", FC="funnel cloud", SS="sand storm", DS="dust storm",
)


def _coded(element: str, codes: dict[str, str]) -> str:
    """A group ``any-ELEMENT`` of one of the codes: an element with the code, and one with what it says."""
    pairs = [f"(says-{c}, meaning-{c})" for c in codes]
    return f"-any-{element} = {' | '.join(pairs)}.\n" + "\n".join(f"says-{c}>{element} = '{c}'. meaning-{c}>{element}-info = +'{said}'." for c, said in codes.items())


def _weather_report() -> str:
    """Routine and special aerodrome reports: groups in the order of the code form, each optional but station and time; trend forecasts have such groups themselves."""
    return f"""
weather_report = head, icao_airport_code, sp, time_of_observation, (sp, observation_type)*, (sp, body | sp, missing)?, close.
-head = (report_type, sp, (correction, sp)?)?.
-body = state, (sp, temperature)?, (sp, air_pressure)*, (sp, supplementary)*, (sp, trend)*, (sp, remark)?.
-state = wind-group, (sp, conditions)? | conditions.
-conditions = cavok | seen, (sp, runway_visual_range)*, (sp, weather)?, (sp, clouds)? | runway_visual_range++sp, (sp, weather)?, (sp, clouds)? | weather, (sp, clouds)? | clouds.
-close = (sp?, -'=')?, -[Zs; #a; #d]*.
-sp = -' '+.
missing = 'NIL'.
-dig = ['0'-'9']. -two = dig, dig. -three = two, dig. -four = two, two.

report_type = 'METAR' | 'SPECI'.
correction>observation_type = 'COR', +'RECTED'.
observation_type = 'AUTO', +'MATIC' | 'COR', +'RECTED'.
icao_airport_code = letter, letter, letter, letter. -letter = ['A'-'Z'].
time_of_observation = month, time, time_zone.
month = two. time = hour, minute. hour = two. minute = two. time_zone = 'Z'.

-wind-group = mean-wind, (sp, turning-wind)?.
mean-wind>wind = wind_direction. turning-wind>wind = wind_variation.
wind_direction = (degrees | variable), speed.
degrees = three | '///'. variable = 'VRB'.
speed = value, (-'G', gusty)?, unit. value = force. gusty = force. -force = 'P'?, two, dig? | '//'. unit = 'KT' | 'MPS' | 'KMH'.
wind_variation = from_degrees, -'V', to_degrees. from_degrees = three. to_degrees = three.

-seen = visibility++sp.
visibility = meters, (-'NDV' | direction)? | miles.
meters = four | '////'. direction = ['NS'], ['EW']? | ['EW'].
miles = ['MP']?, (dig+, (' ', dig, '/', dig+)? | dig, '/', dig+), -'SM'.
cavok = 'CAVOK'.

runway_visual_range = -'R', runway, -'/', reach, (-'V', reach)?, tendency?.
runway = two, ['LCR']*. -reach = (-'P' | below)?, range. range = four. below = -'M', +'less'.
-tendency = steady-sight | rising-sight | falling-sight.
steady-sight>status = -'N', +'nochange'. rising-sight>status = -'U', +'rising'. falling-sight>status = -'D', +'falling'.

weather = phenomena-seen++sp.
phenomena-seen>observation = intensity?, any-chrct?, any-type+ | intensity?, any-chrct.
intensity = -'-', +'light' | -'+', +'heavy' | -'VC', +'in the vicinity'.
{_coded("chrct", DESCRIPTORS)}
{_coded("type", PHENOMENA)}

clouds = sky++sp.
sky>observation = clear-sky | cloud_cover, cloud_base, cloud_type?.
clear-sky>cloud_cover = 'SKC' | 'CLR' | 'NSC' | 'NCD'.
cloud_cover = 'FEW' | 'SCT' | 'BKN' | 'OVC' | 'VV' | '///'. cloud_base = three | '///'. cloud_type = 'TCU' | 'CB' | '///'.

temperature = air_c, -'/', dewpoint_c?.
air_c = celsius. dewpoint_c = celsius. -celsius = (-'M', +'-')?, two.
air_pressure = -'Q', pressure_hpa | -'A', pressure_hg.
pressure_hpa = four. pressure_hg = four.

-supplementary = recent_weather | wind_shear | sea | runway_state.
recent_weather = -'RE', any-chrct?, any-type* .
wind_shear = -'WS ', ('ALL RWY' | 'R', two, ['LCR']*).
sea = -'W', ('M'?, two | '//'), '/', ['SH'], (dig | '/')+.
runway_state = -'R', two, ['LCR']*, '/', (dig | '/' | 'CLRD')+.

trend = 'NOSIG' | view_becoming | temporary.
view_becoming = -'BECMG', (sp, change)+. temporary = -'TEMPO', (sp, change)+.
-change = at | mean-wind | meters | cavok | weather | clouds.
at = ('FM' | 'TL' | 'AT'), four.
remark = -'RMK', (-' ', ~['=']*)?.
"""


GRAMMARS = {
    "data/csv": _separated("','", True),
    "data/scsv": _separated("';'", True),
    "data/tsv": _separated("#9", False),
    "conf/crontab": """
crontab = row, (lf, row)*.
-row = ws, (comment | variable | line)?.
-lf = -#d?, -#a.
-ws = -[' '; #9]*.
-sp = -[' '; #9]+.
comment = -'#', ~[#a; #d]*.
variable = name, ws, -'=', ws, value?.
name = [L; '_'], [L; Nd; '_']*.
value = text-to-end.
line = (minute, sp, hour, sp, day_of_month, sp, month_of_year, sp, day_of_week | -'@', every), sp, command.
minute = times. hour = times. day_of_month = times. month_of_year = dates. day_of_week = dates.
every = ['a'-'z']+.
command = text-to-end.
-times = (span, step?)++','.
-span = '*' | number, ('-', number)?.
-dates = (named-span, step?)++','.
-named-span = '*' | point, ('-', point)?.
-point = number | [L], [L], [L].
-number = ['0'-'9']+.
-step = '/', number.
-text-to-end = ~[' '; #9; #a; #d], ~[#a; #d]*.
""",
    "data/url": """
url = scheme, -'://', host, (-':', port)?, path, (-'?', query)?, (-'#', fragment)?.
scheme = ['a'-'z'; 'A'-'Z'; '+']+.
host = ~['/'; ':'; '?'; '#']+.
port = ['0'-'9']+.
path = ('/', ~['?'; '#']*)?.
query = parameter**-'&'.
parameter = @key, (-'=', value)?.
key = ~['='; '&'; '#']+.
value = ~['&'; '#']*.
fragment = ~[]*.
""",
    "conf/yamlsubset": _yaml(),
    "measurement/metar": _weather_report(),
    "misc/telegram": """
telegram = length, control, manufacturer, id, rest.
length = byte. control = byte. manufacturer = byte, byte. id = byte, byte, byte, byte.
rest = byte*.
-byte = hex, hex.
-hex = ['0'-'9'; 'a'-'f'; 'A'-'F'].
""",
    "core/ixml": """
ixml = s, rule++rs, s.
-s = (whitespace | comment)*.
-rs = (whitespace | comment)+.
-whitespace = -[Zs; #9; #a; #d].
comment = -'{', (cchar | comment)*, -'}'.
-cchar = ~['{}'].
rule = (@mark, s)?, @name, s, -['=:'], s, -alts, -'.'.
mark = ['@^-'].
name = ['a'-'z'; 'A'-'Z'; '_'], ['a'-'z'; 'A'-'Z'; '0'-'9'; '_-']*.
alts = alt++(-[';|'], s).
alt = term**(-',', s).
-term = factor | option | repeat0 | repeat1.
-factor = literal | nonterminal | charset | -'(', s, alts, -')', s.
nonterminal = (@mark, s)?, @name, s.
literal = (@tmark, s)?, (-#22, @dstring, -#22 | -#27, @sstring, -#27 | -'#', @hex), s.
tmark = ['^-'].
dstring = ~[#22; #a]+. sstring = ~[#27; #a]+. hex = ['0'-'9'; 'a'-'f'; 'A'-'F']+.
charset = (@tmark, s)?, '~'?, s, -'[', s, member**(-[';|'], s), -']', s.
member = (-#22, @dstring, -#22 | -#27, @sstring, -#27 | -'#', @hex | @code), s, (-'-', s, to, s)?.
to = -#22, dstring, -#22 | -#27, sstring, -#27 | -'#', hex.
code = ['A'-'Z'], ['a'-'z']?.
option = factor, -'?', s.
repeat0 = factor, -'*', s | factor, -'**', s, sep.
repeat1 = factor, -'+', s | factor, -'++', s, sep.
sep = factor.
""",
    "core/brace": """
brace = s, (node, s)*.
-node = quote | element.
element = @name, s, (-'=', s, value | -'{', s, (node, s)*, -'}')?.
name = ['a'-'z'; 'A'-'Z'; '_'], ['a'-'z'; 'A'-'Z'; '0'-'9'; '_.-']*.
-value = quote | text.
text = ~[' '; #9; #a; #d; "(){}'="; #22]+.
quote = -"'", ~["'"]*, -"'".
-s = -[' '; #a; #d]*.
""",
    "lang/trace": """
trace = line++-#a, -#a?.
line = @level, -': ', message.
level = ['A'-'Z']+.
message = ~[#a]*.
""",
}


def library(spark: SparkSession) -> DataFrame:
    """The names of the grammars."""
    return spark.createDataFrame([(f"ixml:{k}",) for k in sorted(GRAMMARS)], "name string")


@functools.lru_cache(maxsize=64)
def machine(grammar: str) -> Machine:
    """A grammar's machine, by its text or ixml:NAME; made once in a Python worker."""
    return Machine(parse(GRAMMARS[grammar[5:]] if grammar.startswith("ixml:") else grammar))


def parse_text(grammar: str, text: str, every: bool = False, silent: bool = False, recover: bool = False) -> Node:
    """The document of a text; one that doesn't parse gives a failure document, or with ``silent`` an empty one.

    With ``recover`` it is parsed without as few characters as that takes; the root tells how many in an attribute, skipped.
    """
    m = machine(grammar)

    def skipping(rest: str) -> Node:
        doc = m.parse(rest, every)
        if doc.children and doc.children[0].kind == "element":
            doc.children[0].add(Node("attribute", "skipped", value=str(len(text) - len(rest))))
        return doc

    if recover and (rest := m.readable(text)) is not None:
        try:
            return skipping(rest)
        except Failure:
            pass
    try:
        return m.parse(text, every)
    except Failure as f:
        if recover and (kept := kept_characters(m, text)) is not None:
            return skipping("".join(text[i] for i in kept))
        return document() if silent else failure_document(f)


def nodes(df: DataFrame, content: Column | str, grammar: str, doc_id: Column | str = "doc_id", every: bool = False, silent: bool = False, recover: bool = False) -> DataFrame:
    """Rows of NODES of a column of texts parsed by a grammar. The grammar is checked here, on the driver."""
    machine(grammar)
    content = F.col(content) if isinstance(content, str) else content
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    slim = df.select(doc_id.cast("long").alias("doc_id"), content.alias("raw")).filter("raw is not null")
    return tree_rows(slim, lambda row: parse_text(grammar, row["raw"], every, silent, recover))
