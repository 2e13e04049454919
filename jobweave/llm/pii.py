"""Surrogates for personal data, in DataFrame expressions only.

Detected entities get keyed, type-consistent replacements. The distinct canonical entities of the corpus (digits without their
separators, addresses in small letters, single name words) form a small table; each gets one surrogate from a keyed hash, drawn again under
the next attempt number until it equals no entity of the corpus and no other's surrogate. Mentions then render their entity's surrogate in their own
format. So distinct entities stay distinct, and mentions of one entity stay one, across formats, titles and documents.

Kept: lengths, separators, case and script; the calling code of a phone number or its leading zero; the first group of an IPv6 address; the country of an IBAN, with check digits that hold; the
validity of a card number's last digit; the prefix of a key and the label before a password or key; the ending of a domain; the gender of a given name as far as any title in
the corpus tells it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import cut_lineage

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
BREAK = r"[^\p{L}\d\n]{0,6}"
EDGE, STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа", "госпожа", "κυρία"]
NEUTRAL_TITLES = ["Dr", "Prof"]
TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES, key=len, reverse=True))
CASED, UNCASED = ["Latin", "Cyrillic", "Greek"], ["Han", "Hangul", "Hiragana", "Katakana", "Arabic", "Hebrew", "Devanagari"]
#: What may stand between the words of a name and is kept: degrees behind a title, particles, initials.
DEGREES = "med|phil|rer|nat|jur|h\\.c"
PARTICLES = "van|von|vom|zum|zur|zu|der|den|dem|ten|ter|della|del|de|di|da|dos|das|du|la|le|af|av|bin|ibn|al|el"
UPPER, LOWER = rf"[{''.join(rf'\p{{Is{s}}}' for s in CASED)}&&\p{{Lu}}]", r"[\p{Ll}\p{M}]"
#: One word of a name, with inner capitals and apostrophes, but without a genitive's ending.
CAPITALISED = rf"{UPPER}(?:{LOWER}++|['’]{UPPER}{LOWER}++)(?:{UPPER}{LOWER}++|['’]{UPPER}{LOWER}++|['’](?!s{STOP}){LOWER}++|{UPPER}++(?!{LOWER})){{0,2}}+"
CAPITALS = rf"{UPPER}['’]?{UPPER}++(?!{LOWER})"
#: In scripts without spaces a run of up to four signs, or the first two of a longer one.
SIGNS = rf"[{''.join(rf'\p{{Is{s}}}' for s in UNCASED[:4])}&&\p{{L}}]"
SPACED = rf"[{''.join(rf'\p{{Is{s}}}' for s in UNCASED[4:])}&&[\p{{L}}\p{{M}}]]{{2,}}+"
NAME_WORD = rf"{CAPITALISED}|{CAPITALS}|{SIGNS}{{2,4}}|{SPACED}"
TITLE_RUN = rf"(?:{TITLES})\.? (?:(?:{TITLES}|{DEGREES})\.? ){{0,4}}+"
LINK = rf"(?:{UPPER}\. ?){{0,2}}+(?:(?:{PARTICLES}) ){{0,3}}+(?:d['’])?+"
NEXT = rf"(?:-| {LINK})"
CASED_NAME = rf"{LINK}(?:{CAPITALISED}(?:{NEXT}{CAPITALISED}){{0,2}}(?: {LINK}{UPPER}{{4,}}+(?!{LOWER}))?|{CAPITALS}(?:{NEXT}{CAPITALS}){{0,2}})"
NAME_WORDS = rf"(?:{CASED_NAME}|{SIGNS}{{2,4}}(?!{SIGNS})|{SIGNS}{{2}}|{SPACED}(?: {SPACED}){{0,2}})"
LONG_PREFIX = r"(?:sk-(?:proj|ant|or|live|test)-|(?:sk|pk|rk)_(?:live|test)_|github_pat_|glpat-|xox[abeoprs]-)"
SHORT_PREFIX = r"(?:sk|pk|ghp|gho|ghs|ghu|ghr|hf|AKIA|ASIA|AIza)[-_]?"
KEY = rf"(?:{LONG_PREFIX}(?=[A-Za-z_-]{{0,64}}+\d)[A-Za-z0-9_-]{{16,}}+|{SHORT_PREFIX}(?=[A-Za-z]*+\d)[A-Za-z0-9]{{16,}}+)"
TOKEN = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
#: What names the value behind it; it is kept.
SECRET_LABEL = r"(?i:pass(?:word|wd|phrase|code)|pwd|(?:client[_ -]?)?secret(?:[_ -]?access)?(?:[_ -]?key)?|api[_ -]?key|access[_ -]?key|auth[_ -]?token|token)[\"']? {0,2}[:=] {0,2}[\"']?"
PHONE_LABEL = r"(?i:tel(?:efon|ephone)?|phone|fax|mobile?|cell|call)\.?:? {1,2}"
LABEL = rf"(?:{SECRET_LABEL}|{PHONE_LABEL})"
HEX = "[0-9A-Fa-f]"
#: Patterns by type, in order of preference where several begin at one place. No repetition of a group is longer than a few rounds, so matching needs no
#: stack that grows with the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}][\p{L}\p{N}.-]*\.\p{L}{2,}+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": rf"{EDGE}(?:(?:(?=\p{{L}}*+\d)(?=\d*+\p{{L}})(?:[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+)|{KEY}|{TOKEN}){STOP}|(?:[A-Za-z]{{1,16}}_){{0,2}}{SECRET_LABEL}(?=[^\s\"',;<>]{{0,128}}?\d)[^\s\"',;<>]{{6,}}+)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{HEX}{{1,4}}:){{7}}{HEX}{{1,4}}|(?:[23]{HEX}{{3}}|[Ff][C-Fc-f]{HEX}{{2}})(?::{HEX}{{1,4}}){{0,5}}::{HEX}{{1,4}}(?::{HEX}{{1,4}}){{0,5}})(?![\p{{L}}\p{{N}}:])",
    "mac": rf"(?<![\p{{L}}\p{{N}}:-])(?=[A-Fa-f:-]{{0,15}}+\d)(?:(?:{HEX}{{2}}:){{5}}{HEX}{{2}}|(?:{HEX}{{2}}-){{5}}{HEX}{{2}})(?![\p{{L}}\p{{N}}:-])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "phone": rf"(?<!\d)(?:\+\d{{1,3}}{BREAK}\(\d{{1,4}}\){BREAK}\d{{3,4}}[- .]\d{{3,4}}|\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{3,5}}|\(\d{{3}}\){BREAK}\d{{3}}[- .]\d{{4}}|(?:\d{{3}}[- .])?\d{{3}}-\d{{4}}|0[1-9]\d{{1,3}}[ /]\d{{6,8}})(?!\d)|{EDGE}{PHONE_LABEL}\d{{10,11}}(?!\d)",
    "number": r"(?<![\d.,-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{3}-\d{2}-\d{4})(?![\d-])",
    "name": rf"{EDGE}{TITLE_RUN}{NAME_WORDS}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: In a text that names someone: also each run of words that could be that name without its title. A run ends before what another pattern takes.
GUARD = rf"(?!(?:{TITLES})\.? |[\p{{L}}\p{{N}}._%+-]++@|{LABEL})"
ANY_OR_WORD = rf"{ANY}|{EDGE}(?:{CAPITALISED}(?:[ -]{GUARD}{CAPITALISED}){{0,3}}|{CAPITALS}|{SIGNS}{{2,4}}|{SPACED}){STOP}"
#: Every entity holds an @, a digit or a title: a quick look that spares most texts the patterns.
MAY_HOLD = rf"[@\d]|(?=[{''.join(sorted({t[0] for t in TITLES.split('|')}))}]){EDGE}(?:{TITLES})\.? (?:[\p{{Lu}}\p{{Lo}}]|(?:{PARTICLES}) |d['’])"
#: Names that are also common words: alone they are replaced only next to another word of a name.
ORDINARY = (
    "april art august bill black brown bush carol chance chase christian church clay cook cross dale dean duke earl faith field fields fisher ford forest "
    "france frank gene glen grace grant gray green hall hill holly hope hunt hunter iris ivy jack jade joy june king lake lane long lily love march mark "
    "marsh mason may miles moon nick page park paris pat penny person pierce power price prince rich rick rob robin rock rose ruby rush skip small star stone "
    "storm summer sue temple terry todd victor violet wade wall ward water waters way white will wood woods young"
)
#: Calling codes of one and two digits; all others have three.
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Given names for the first attempt; later attempts build names from syllables.
GIVEN = {
    ("Latin", "m"): "Adrian Bruno Caspar Dario Emil Fabian Gideon Hugo Ivo Jonas Konrad Leon Marius Nils Oskar Pascal Quentin Rafael Simon Tobias",
    ("Latin", "f"): "Alma Berta Clara Dora Elena Flora Greta Helena Ines Julia Klara Livia Marta Nora Olga Paula Rosa Silvia Tilda Vera",
    ("Latin", "n"): "Alex Andrea Billie Casey Dominique Eden Francis Jamie Kim Lou Marion Noel Robin Sascha Toni Valery",
    ("Cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Олег Павел Роман Семён Фёдор",
    ("Cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья",
    ("Cyrillic", "n"): "Саша Женя Валя Слава",
    ("Greek", "m"): "Γιάννης Νίκος Κώστας Δημήτρης Ανδρέας Πέτρος Σπύρος Μιχάλης",
    ("Greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δέσποινα Ειρήνη Χριστίνα",
    ("Arabic", "m"): "أحمد محمود سامي كريم طارق رامي نبيل ياسر",
    ("Arabic", "f"): "ليلى مريم سلمى هدى نور ريم سارة دينا",
    ("Hebrew", "m"): "דוד יוסף אורי נועם איתן גיל רון עמית",
    ("Hebrew", "f"): "שרה רחל נועה תמר מיכל יעל דנה רות",
    ("Devanagari", "m"): "राहुल अमित रवि संजय विजय अजय मोहन सुनील",
    ("Devanagari", "f"): "प्रिया अनीता सुनीता कविता नेहा पूजा रीना मीरा",
}
#: What built names are made of, and what ends them by gender (s: a family name). In the signs of the Han script and of Hangul a family name leads.
SYLLABLES = {
    "Latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi mo na ne no pa ra re ri ro sa so ta te",
    "Cyrillic": "ба бе бо да де до ка ке ко ла ле ли ло ма ме ми мо на не но па ра ре ри ро са со та те",
    "Greek": "βα βε βο δα δε δο κα κε κο λα λε λι λο μα με μι μο να νε νο πα ρα ρε ρι ρο σα σο τα τε",
    "Han": "文 华 新 宁 安 晨 云 林 山 海 天 雨 春 秋 冬 夏",
    "Hangul": "서 진 하 윤 도 라 온 별 솔 람 누 리 한 결 새 봄",
    "Hiragana": "あ い う え お か き く け こ さ し す せ そ た ち つ て と な に は ひ",
    "Katakana": "ア イ ウ エ オ カ キ ク ケ コ サ シ ス セ ソ タ チ ツ テ ト ナ ニ ハ ヒ",
    "Arabic": "با تا جا دا را سا فا كا لا ما نا وا بي تي دي ري سي لي مي ني",
    "Hebrew": "בא גא דא לא מא נא רא שא תא בי די לי מי ני רי שי",
    "Devanagari": "का गा जा ता दा ना पा बा मा रा ला सा कि नि मि रि",
}
LEADING = {"Han": "王 李 张 刘 陈 杨 黄 赵 周 吴 徐 孙", "Hangul": "김 이 박 최 정 강 조 윤 장 임"}
ENDINGS = {
    ("Latin", "m"): "n", ("Latin", "f"): "na", ("Latin", "n"): "l", ("Latin", "s"): "rt",
    ("Cyrillic", "m"): "н", ("Cyrillic", "f"): "на", ("Cyrillic", "n"): "ль", ("Cyrillic", "s"): "ров",
    ("Greek", "m"): "ς", ("Greek", "f"): "να", ("Greek", "n"): "λι", ("Greek", "s"): "κος",
    ("Han", "m"): "强", ("Han", "f"): "娜", ("Hangul", "m"): "준", ("Hangul", "f"): "희",
    ("Hiragana", "m"): "お", ("Hiragana", "f"): "こ", ("Katakana", "m"): "オ", ("Katakana", "f"): "コ",
}
ALPHABETS = {"Cyrillic": ("абвгдежзиклмнопрстуфхцшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦШЭЮЯ"), "Greek": ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), "Latin": ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")}


@dataclass(frozen=True)
class PiiParams:
    key: str  # the secret: the same key gives the same surrogates, and whoever has it can recompute them
    attempts: int = 8  # draws in the original's format, before a counter is built in

    def __post_init__(self):
        if not self.key:
            raise ValueError("surrogates need a secret key")


def kind_of(mention: Column) -> Column:
    """The type of a mention; null for a word that is none by itself."""
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()])


def pick(pool: Column, number: Column) -> Column:
    """A member of an array; null of an empty one."""
    return F.get(pool, F.pmod(number, F.greatest(F.lit(1), F.size(pool))).cast("int"))


def drawn(value: Column, attempt: Column, params: PiiParams, salt: Column) -> Column:
    """The hex digits of a keyed hash."""
    return F.sha2(F.concat_ws("\x1f", F.lit(params.key), salt, value, attempt.cast("string"), F.lit(params.key)), 512)


def number_at(digest: Column, place: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, place.cast("int"), F.lit(digits)), 16, 10).cast("long")


def reshaped(value: Column, digest: Column, hexadecimal: Column) -> Column:
    """Each digit and letter replaced by one of its class and script; all else stays."""

    def one(c: Column, i: Column) -> Column:
        n = number_at(digest, F.pmod(i, F.lit(62)) * 2 + 1, 2) + F.pmod(F.floor(i / 62), F.lit(97))
        of = F.when(c.rlike("[0-9]"), F.lit("0123456789")).when(hexadecimal & c.rlike("[a-f]"), "abcdef").when(hexadecimal & c.rlike("[A-F]"), "ABCDEF")
        for case, at in (("Ll", 0), ("Lu", 1)):
            for script, letters in ALPHABETS.items():
                of = of.when(c.rlike(rf"[\p{{Is{script}}}&&\p{{{case}}}]"), letters[at])
            of = of.when(c.rlike(rf"\p{{{case}}}"), ALPHABETS["Latin"][at])
        for script in UNCASED:
            of = of.when(c.rlike(rf"[\p{{Is{script}}}&&\p{{L}}]"), "".join(x[0] for x in SYLLABLES[script].split()))
        of = of.when(c.rlike(r"\p{L}"), ALPHABETS["Latin"][0])
        return F.coalesce(F.substring(of, F.pmod(n, F.length(of)).cast("int") + 1, F.lit(1)), c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + x)


def with_check_digit(value: Column, plain: Column) -> Column:
    """Digits; those of a Luhn-valid number get a last digit that makes them valid."""
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    last = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return F.when((F.length(value) >= 13) & (F.pmod(luhn_sum(value), F.lit(10)) == 0), F.concat(body, last)).otherwise(plain)


def remainder_97(value: Column) -> Column:
    """Of an IBAN's characters, letters as numbers from 10 on."""
    number = F.transform(F.split(value, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(number, F.lit(0), lambda total, x: F.pmod(total * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def ip_surrogate(value: Column, digest: Column) -> Column:
    """Octets of as many digits as the original's."""

    def octet(x: Column, i: Column) -> Column:
        n = number_at(digest, i * 6 + 1, 6)
        return F.when(F.length(x) == 3, 100 + F.pmod(n, F.lit(155))).when(F.length(x) == 2, 10 + F.pmod(n, F.lit(90))).otherwise(1 + F.pmod(n, F.lit(9))).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def name_tables(script: Column, style: Column) -> dict[str, Column]:
    """What a name of a script and style (m, f or n for a given name, s for a family name) is made of: four literals, looked up."""

    def found(table: dict[str, str], key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)

    both = {**{f"{s}:{g}": names for (s, g), names in GIVEN.items()}, **{f"{s}:n": f"{GIVEN[s, 'm']} {GIVEN[s, 'f']}" for s, g in GIVEN if g == "m" and (s, "n") not in GIVEN}}
    key = F.concat_ws(":", script, style)
    return {
        "given": F.split(found(both, key), " "),
        "syllables": F.split(found(SYLLABLES, script), " "),
        "leading": F.split(found(LEADING, script), " "),
        "ending": F.coalesce(found({f"{s}:{g}": x for (s, g), x in ENDINGS.items()}, key), F.lit("")),
    }


def name_surrogate(value: Column, digest: Column, attempt: int) -> Column:
    """From the columns of name_tables: a given name on the first attempt where there is a list of them, else one built from syllables.

    Where a sign is a syllable there are as many as in the original, and one more for each two attempts.
    """
    signs = F.col("script").isin(UNCASED[:4])
    size = F.when(signs, F.greatest(F.lit(1), F.length(value) - F.lit(1) - F.length("ending") + attempt // 2)).otherwise(attempt + 2)
    syllables = F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: pick(F.col("syllables"), number_at(digest, F.pmod(i, F.lit(30)) * 4 + 1, 4))), "")
    number = number_at(digest, F.lit(1), 12)
    built = F.concat(F.coalesce(pick(F.col("leading"), number), F.lit("")), syllables, "ending")
    built = F.when(F.col("script").isin(CASED), F.initcap(built)).otherwise(built)
    return F.coalesce(pick(F.col("given"), number), built) if attempt == 0 else built


def with_surrogate(entities: DataFrame, attempt: int, params: PiiParams) -> DataFrame:
    """entities (kind, value, head, tail, script, ... of prepared) with the attempt's canonical surrogate."""
    kind, value = F.col("kind"), F.col("value")
    salt = F.when(kind.startswith("email"), F.lit("email")).otherwise(kind)
    rows = entities.withColumn("digest", drawn(value, F.lit(attempt), params, salt))
    body = F.substring(value, F.length("head") + F.when(kind == "iban", 3).otherwise(1), F.length(value) - F.length("head") - F.length("tail"))
    rows = rows.withColumn("plain", F.when(~kind.isin("ip", "name"), reshaped(body, F.col("digest"), kind.isin("ip6", "mac") | ((kind == "secret") & (F.col("head") == "")))))
    check = F.lpad((F.lit(98) - remainder_97(F.concat("plain", "head", F.lit("00")))).cast("string"), 2, "0")
    out = (
        F.when(kind == "ip", ip_surrogate(value, F.col("digest")))
        .when(kind == "number", with_check_digit(value, F.col("plain")))
        .when(kind == "iban", F.concat("head", check, "plain"))
        .when(kind == "name", name_surrogate(value, F.col("digest"), attempt))
        .otherwise(F.concat("head", "plain", "tail"))
    )
    return rows.withColumn("surrogate", out).drop("digest", "plain")


def prepared(entities: DataFrame) -> DataFrame:
    """kind, value (distinct) with what a surrogate keeps (head and tail of the value) and what a name is made of.

    A name's word is a given name where any mention (style m, f, n) has it so, of the gender that its mentions agree on.
    """
    has = lambda s: F.max((F.col("style") == s).cast("int"))
    merged = entities.groupBy("kind", "value").agg(*(has(s).alias(s) for s in ("m", "f", "n")))
    style = F.when(F.col("m") + F.col("f") + F.col("n") == 0, "s").when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    kind, value = F.col("kind"), F.col("value")
    head = F.when(kind == "phone", F.regexp_extract(value, rf"{CALLING}|^0", 0)).when((kind == "secret") & value.rlike(rf"^(?:{KEY}|{TOKEN})$"), F.regexp_extract(value, rf"^(?:{LONG_PREFIX}|{SHORT_PREFIX}|eyJ)", 0)).when(kind == "ip6", F.substring_index(value, ":", 1)).when(kind == "iban", F.substring(value, 1, 2)).otherwise("")
    tail = F.when(kind == "domain", F.concat(F.lit("."), F.substring_index(value, ".", -1))).otherwise("")
    script = F.when(kind == "name", F.coalesce(*[F.when(value.rlike(rf"\p{{Is{s}}}"), F.lit(s)) for s in [*UNCASED, *CASED[::-1]]]))
    rows = merged.select("kind", "value", style.alias("style"), head.alias("head"), tail.alias("tail"), script.alias("script"))
    return rows.withColumns(name_tables(F.col("script"), F.col("style"))).drop("style")


def surrogates(entities: DataFrame, params: PiiParams) -> DataFrame:
    """kind, value, surrogate: of the distinct entities of (kind, value, style); surrogates are distinct within a kind and equal no entity of it."""
    left = cut_lineage(prepared(entities))
    taken = left.select("kind", F.col("value").alias("surrogate"))
    done = None
    for attempt in range(params.attempts + 1):
        tried = with_surrogate(left, attempt, params)
        if attempt == params.attempts:  # the format has no room left: a counter from the keyed hash makes it distinct
            tried = tried.withColumn("surrogate", F.concat("surrogate", F.lit("-"), F.substring(drawn(F.col("value"), F.lit(attempt), params, F.lit("counter")), 1, 16)))
        free = tried.join(taken, ["kind", "surrogate"], "left_anti")
        won = cut_lineage(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"))
        done = won if done is None else done.unionByName(won)
        left = cut_lineage(left.join(won, ["kind", "value"], "left_anti"))
        if left.isEmpty():
            break
        taken = taken.unionByName(won.select("kind", "surrogate"))
    return done


def without_label(mention: Column) -> Column:
    """A mention without what only names it."""
    return F.regexp_replace(mention, rf"^(?:[A-Za-z]{{1,16}}_){{0,2}}{LABEL}", "")


def without_title(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^{TITLE_RUN}", "")


def name_words(mention: Column) -> Column:
    return F.regexp_extract_all(without_title(mention), F.lit(NAME_WORD), F.lit(0))


def entity(kind: Column, value: Column, style: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), style.alias("style"))


def entities_of(mention: Column, kind: Column) -> Column:
    """(kind, canonical value, style) of what a mention is made of.

    Style is what the mention tells of a name's word: m, f or n for a given name, s for a family name (the last word, if its script has spaces).
    """
    title = F.concat(F.lit(" "), F.regexp_extract(mention, rf"^{TITLE_RUN}", 0))
    said = lambda titles: title.rlike(rf" (?:{'|'.join(titles)})\.? ")
    gender = F.when(said(MALE_TITLES), "m").when(said(FEMALE_TITLES), "f").otherwise("n")
    words = name_words(mention)
    name = lambda w: F.initcap(F.lower(w))
    names = F.transform(words, lambda w, i: entity(F.lit("name"), name(w), F.when((i == F.size(words) - 1) & ~w.rlike(SIGNS), "s").otherwise(gender)))
    none = F.lit("")
    domain = F.lower(F.substring_index(mention, "@", -1))
    address = F.array(entity(F.concat(F.lit("email@"), domain), F.lower(F.substring_index(mention, "@", 1)), none), entity(F.lit("domain"), domain, none))
    digits = F.regexp_replace(mention, r"\D", "")
    canonical = (
        F.when(kind == "number", digits)
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.isin("ip6", "mac"), F.lower(F.translate(mention, "-", ":")))
        .when(kind == "secret", without_label(mention))
        .otherwise(mention)
    )
    single = F.array(entity(kind, canonical, none))
    return F.when(kind.isNull() | (kind == "name"), names).when(kind == "email", address).otherwise(single)


def with_kind(mention: Column) -> Column:
    return F.struct(mention.alias("text"), kind_of(mention).alias("kind"))


def filled(mention: Column, drawn_: Column) -> Column:
    """The mention with its digits and capitals replaced one by one by those of a surrogate; what the surrogate has over goes to the end."""
    held = lambda upto: F.length(F.regexp_replace(F.substring(mention, F.lit(1), upto), "[^0-9A-Z]", ""))
    out = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substring(drawn_, held(i + 1), F.lit(1))).otherwise(c)), "")
    return F.concat(out, F.substring(drawn_, held(F.length(mention)) + 1, F.length(drawn_)))


def in_case_of(mention: Column, drawn_: Column) -> Column:
    """A surrogate in small letters with the capitals of the mention."""
    same = lambda c, m: F.when(F.coalesce(m, F.lit("")).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)
    return F.array_join(F.zip_with(F.split(drawn_, ""), F.split(mention, ""), same), "")


def renamed(text: Column, own: Column) -> Column:
    """A name with its words replaced; a word without a surrogate stays, as does all between the words. Capitals throughout stay so."""
    body = without_title(text)
    between, words = F.split(body, NAME_WORD), name_words(text)
    new = lambda w, s: F.when(w.rlike(rf"^{CAPITALS}$"), F.upper(s)).otherwise(s)
    pieces = F.transform(F.arrays_zip(words.alias("w"), own.alias("s"), F.slice(between, F.lit(2), F.size(words)).alias("b")), lambda z: F.concat(F.coalesce(new(z["w"], z["s"]), z["w"]), z["b"]))
    return F.concat(F.regexp_extract(text, rf"^(?:{TITLE_RUN})?", 0), F.get(between, F.lit(0)), F.array_join(pieces, ""))


def rendered(mention: Column, own: Column) -> Column:
    """The replacement of a mention (text, kind, parts); own: the surrogates of its parts. Words that are no entity of their text stay."""
    text, kind = mention["text"], mention["kind"]
    first, second = F.get(own, F.lit(0)), F.get(own, F.lit(1))
    body = without_label(text)
    label = F.substring(text, F.lit(1), F.length(text) - F.length(body))
    return (
        F.when(kind.isNull() | (kind == "name"), renamed(text, own))
        .when(kind == "email", in_case_of(text, F.concat(first, F.lit("@"), second)))
        .when(kind.isin("number", "phone", "iban"), F.concat(label, filled(body, F.replace(first, F.lit("+"), F.lit("")))))
        .when(kind == "mac", in_case_of(text, F.when(F.contains(text, F.lit("-")), F.translate(first, ":", "-")).otherwise(first)))
        .when(kind == "ip6", in_case_of(text, first))
        .when(kind == "secret", F.concat(label, first))
        .otherwise(first)
    )


def pseudonymised(docs: DataFrame, params: PiiParams) -> DataFrame:
    """docs with every detected entity in text replaced by its surrogate, and pii_entities (the number of mentions) appended.

    Names are found behind titles, and in the same text also without them, word by word. A single word that the text also has in small letters, or that
    is a common word (ORDINARY), is taken for that word, unless another word of a name stands beside it. Particles and initials stay. Null and empty texts pass through with 0 mentions; all other columns
    and repeated rows pass through, but for a column named pii_entities, which is replaced. Null doc_ids are fine: texts are joined with
    surrogates by entity and by text hash, not by id. Texts of any length are matched without recursion.
    """
    base = docs.drop("pii_entities")
    text = F.col("text").cast("string")
    # The patterns run over each text once; what they found is kept with the rows.
    marked = cut_lineage(base.withColumn("_pii_found", F.when(text.rlike(MAY_HOLD), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))))
    touched = F.coalesce(F.size("_pii_found"), F.lit(0)) > 0
    key = F.sha2(text, 256).alias("_pii_key")
    texts = marked.where(touched).select(key, text.alias("text"), F.transform("_pii_found", with_kind).alias("found")).dropDuplicates(["_pii_key"])
    names = F.exists("found", lambda m: m["kind"] == "name")
    again = F.transform(F.regexp_extract_all("text", F.lit(ANY_OR_WORD), F.lit(0)), with_kind)
    texts = texts.withColumns({"found": F.when(names, again).otherwise(F.col("found")), "rest": F.when(names, F.split("text", ANY_OR_WORD)).otherwise(F.split("text", ANY))})
    small = F.array_union(F.regexp_extract_all("text", F.lit(rf"{EDGE}{LOWER}++{STOP}"), F.lit(0)), F.split(F.lit(ORDINARY), " "))
    texts = texts.withColumn("small", F.when(names, small))
    texts = cut_lineage(texts.select("_pii_key", F.transform("found", lambda m: F.struct(m["text"].alias("text"), m["kind"].alias("kind"), entities_of(m["text"], m["kind"]).alias("parts"))).alias("found"), "rest", "small"))
    # Of the text's words in small letters only those that are a name's are kept.
    named = F.flatten(F.transform(F.filter("found", lambda m: m["kind"] == "name"), lambda m: F.transform(m["parts"], lambda p: F.lower(p["value"]))))
    cased = F.filter(named, lambda w: w != F.initcap(w))
    texts = cut_lineage(texts.withColumn("small", F.coalesce(F.array_intersect(cased, "small"), F.array().cast("array<string>"))))
    listed = F.flatten(F.transform(F.filter("found", lambda m: m["kind"].isNotNull()), lambda m: m["parts"]))
    entities = texts.select("_pii_key", F.explode(F.array_distinct(listed)).alias("e")).select("_pii_key", "e.*")
    known = cut_lineage(surrogates(entities, params))
    pair = F.struct(F.concat_ws("\x1f", "kind", "value"), "surrogate")
    maps = entities.select("_pii_key", "kind", "value").distinct().join(known, ["kind", "value"]).groupBy("_pii_key").agg(F.map_from_entries(F.collect_list(pair)).alias("map"))
    look = lambda p: F.try_element_at("map", F.concat_ws("\x1f", p["kind"], p["value"]))

    def own(m: Column) -> Column:
        sure = m["kind"].isNotNull() | (F.size(F.filter(m["parts"], lambda p: look(p).isNotNull())) > 1)
        return F.transform(m["parts"], lambda p: F.when(sure | ~F.array_contains("small", F.lower(p["value"])), look(p)))

    new = texts.join(maps, "_pii_key").withColumn("own", F.transform("found", own))
    swapped = F.transform(F.arrays_zip("found", "own"), lambda z: rendered(z["found"], z["own"]))
    pieces = F.transform(F.arrays_zip(swapped.alias("s"), F.slice("rest", F.lit(2), F.size("found")).alias("b")), lambda z: F.concat(z["s"], z["b"]))
    count = F.size(F.filter("own", lambda o: F.exists(o, lambda s: s.isNotNull())))
    new = new.select("_pii_key", F.concat(F.get("rest", F.lit(0)), F.array_join(pieces, "")).alias("_pii_text"), count.alias("_pii_n"))
    held = marked.where(touched).withColumn("_pii_key", key).join(new, "_pii_key")
    order = [F.col("_pii_text").alias(c) if c.lower() == "text" else F.col(c) for c in base.columns]
    return held.select(*order, F.col("_pii_n").alias("pii_entities")).unionByName(marked.where(~touched).select(*base.columns, F.lit(0).alias("pii_entities")))
