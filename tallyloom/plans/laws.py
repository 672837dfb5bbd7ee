"""Titles of acts: kind, scope, action, facility, beds, terms of office.

The tables below are data; the logic is :mod:`tallyloom.operators.rules`. All of it is
one projection of built-in functions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import referenced_acts, squeeze
from ..operators import intervals
from ..operators.rules import Rule, bound, first_match, ladder

# --- fixed values ------------------------------------------------------------
# Categories and their scope; terms; patterns; word lists. They must equal the
# published rules for right results.

SCOPES = {
    "school": "local", "college": "local", "hospital": "local", "lgu": "local", "rename_place": "local", "road": "local", "court": "local", "office": "local",
    "holiday": "local", "district": "local", "land": "local", "public_works": "local", "other_local": "local",
    "franchise": "private", "citizenship": "private", "private_other": "private", "commemoration": "national", "appropriation": "national", "national": "national",
}

CONGRESSES = [
    (1, date(1946, 5, 25), date(1949, 12, 29)), (2, date(1949, 12, 30), date(1953, 12, 29)), (3, date(1953, 12, 30), date(1957, 12, 29)),
    (4, date(1957, 12, 30), date(1961, 12, 29)), (5, date(1961, 12, 30), date(1965, 12, 29)), (6, date(1965, 12, 30), date(1969, 12, 29)),
    (7, date(1969, 12, 30), date(1973, 1, 16)), (8, date(1987, 7, 27), date(1992, 7, 26)), (9, date(1992, 7, 27), date(1995, 7, 23)),
    (10, date(1995, 7, 24), date(1998, 7, 26)), (11, date(1998, 7, 27), date(2001, 7, 22)), (12, date(2001, 7, 23), date(2004, 7, 25)),
    (13, date(2004, 7, 26), date(2007, 7, 22)), (14, date(2007, 7, 23), date(2010, 7, 25)), (15, date(2010, 7, 26), date(2013, 7, 21)),
    (16, date(2013, 7, 22), date(2016, 7, 24)), (17, date(2016, 7, 25), date(2019, 7, 21)), (18, date(2019, 7, 22), date(2022, 7, 24)),
    (19, date(2022, 7, 25), date(2025, 7, 27)), (20, date(2025, 7, 28), date(2028, 7, 23)),
]

PRESIDENTS = [
    ("Roxas", date(1946, 5, 28), date(1948, 4, 15)), ("Quirino", date(1948, 4, 17), date(1953, 12, 30)), ("Magsaysay", date(1953, 12, 30), date(1957, 3, 17)),
    ("Garcia", date(1957, 3, 18), date(1961, 12, 30)), ("Macapagal", date(1961, 12, 30), date(1965, 12, 30)), ("Marcos Sr.", date(1965, 12, 30), date(1986, 2, 25)),
    ("Aquino", date(1986, 2, 25), date(1992, 6, 30)), ("Ramos", date(1992, 6, 30), date(1998, 6, 30)), ("Estrada", date(1998, 6, 30), date(2001, 1, 20)),
    ("Arroyo", date(2001, 1, 20), date(2010, 6, 30)), ("Aquino III", date(2010, 6, 30), date(2016, 6, 30)), ("Duterte", date(2016, 6, 30), date(2022, 6, 30)),
    ("Marcos Jr.", date(2022, 6, 30), date(2028, 6, 30)),
]

PROVINCES = [
    "Abra", "Agusan", "Agusan del Norte", "Agusan del Sur", "Aklan", "Albay", "Antique", "Apayao", "Aurora", "Basilan", "Bataan", "Batanes", "Batangas", "Benguet", "Biliran",
    "Bohol", "Bukidnon", "Bulacan", "Cagayan", "Camarines Norte", "Camarines Sur", "Camiguin", "Capiz", "Catanduanes", "Cavite", "Cebu", "Compostela Valley", "Cotabato", "Davao",
    "Davao Occidental", "Davao Oriental", "Davao de Oro", "Davao del Norte", "Davao del Sur", "Dinagat Islands", "Eastern Samar", "Guimaras", "Ifugao", "Ilocos Norte", "Ilocos Sur",
    "Iloilo", "Isabela", "Kalinga", "Kalinga-Apayao", "La Union", "Laguna", "Lanao", "Lanao del Norte", "Lanao del Sur", "Leyte", "Maguindanao", "Marinduque", "Masbate", "Mindoro",
    "Misamis Occidental", "Misamis Oriental", "Mountain Province", "Negros Occidental", "Negros Oriental", "North Cotabato", "Northern Samar", "Nueva Ecija", "Nueva Vizcaya",
    "Occidental Mindoro", "Oriental Mindoro", "Palawan", "Pampanga", "Pangasinan", "Quezon", "Quirino", "Rizal", "Romblon", "Samar", "Sarangani", "Siquijor", "Sorsogon",
    "South Cotabato", "Southern Leyte", "Sultan Kudarat", "Sulu", "Surigao", "Surigao del Norte", "Surigao del Sur", "Tarlac", "Tawi-Tawi", "Zambales", "Zamboanga",
    "Zamboanga Sibugay", "Zamboanga del Norte", "Zamboanga del Sur", "Metro Manila", "Western Samar", "Mindoro Oriental", "Mindoro Occidental",
]
_PROVINCE = "|".join(sorted(PROVINCES, key=len, reverse=True))

PUBLIC_WORKS_ACTS = [670, 920, 1200, 1411, 1613, 1900, 2093, 2301, 2701, 3101, 5187, 5979]

SPECIFIC_PLACE = (
    r"(?U)(\b(?i:(?:municipality|province|city|barangay|barrio|sitio|town|island|islands|municipal district|poblacion|district))s? (?i:of) (?:(?i:the) )?[A-Z]"
    r"|\b(?i:barangays?|barrios?|sitios?) (?!(?:Officials?|Elections?|Health|Roads?|Captains?|Chair\w*|Tanods?|Councils?|Workers?|Level|Justice|Kagawads?|Secretar\w*|Treasurer\w*|Nutrition)\b)[A-Z]"
    r"|\b(?!(?:Component|Chartered|Urbanized|Independent|Said|Such|New|Each|Every|Any|Capital|Inner|Mother|Highly|The|A|Of)\b)"
    r"[A-Z][a-zñ]+(?: (?!(?:Component|Chartered|Urbanized|Independent)\b)[A-Z][a-zñ]+)? (?i:city)\b"
    r"|\b(?i:metro(?:politan)? manila)\b|\b(?i:city|mayor|vice-mayor|municipal board|auditor|treasurer|charter|fiscal|engineer) (?i:of) Manila\b"
    r"|\b(?i:in|at) [A-Z][a-zñ]+(?: [A-Z][a-zñ]+)?, (?:(?i:province of) )?(?:" + _PROVINCE + r")\b)"
)
NATIONAL_HINT = (
    r"\b(of the philippines|nationwide|in the philippines|throughout the (country|philippines)|all (cities|municipalities|provinces|barangays)|"
    r"(every|each) (city|municipality|province|barangay|region)|conference|embassy|legation|consulate)\b"
)
EVERYWHERE = r"\b((all|every|each) (barangays?|cities|city|municipalit(y|ies)|provinces?|regions?)|nationwide|throughout the (country|philippines)|(in )?the entire country)\b"
FACILITY = r"\b(school|hospital|street|avenue|road|bridge|college|university|river|fort|park|plaza|hall|market|highway|boulevard|center|centre|station|port|airport|church|lake|mountain|mount|creek|falls)\b"
PUBLIC_WORKS = (
    r"(amend\w* (and repeal\w* )?(a )?(certain )?(items?|priority number)|\bitems? \(?[a-z0-9]+\)?,? (under|on page|page|paragraph|subparagraph|group|title)|"
    r"priority number|public works (projects|and projects) for|regarding public works)"
)

RULE_PATTERNS = [
    ("appropriation", r"(appropriating funds for public works$|appopriating funds for the operation of the government|defray the expenses of the national government|general appropriations|supplemental (appropriations|budget)|appropriating funds for the operation of the government|"
     r"appropriating (funds|the sum|additional|the amount) .* (fiscal year|for the (operation|expenses))|public works (act|appropriations)|reappropriat|(fiscal|calendar) year (19|20)\d\d)"),
    ("citizenship", r"(granting (the )?(philippine )?citizenship|citizenship (to|upon|on) [A-Z]|conferring .*citizenship|declaring .* (a )?citizens? of the philippines|adopting .* as (a )?(son|daughter) of the philippines|naturaliz(ing|ation of) [A-Z])"),
    ("franchise", r"(franchise|temporary permit to (construct|establish|operate|install)|radio(-| )?(telephone|telegraph) station)|permit to (construct|establish|operate|install|maintain)"),
    ("office_specific", r"(district engineering office|engineering district|highway engineering district|land transportation office|\blto\b|district office|extension office|satellite office|licensing center)"),
    ("public_works", PUBLIC_WORKS),
    ("district", r"(reapportion|legislative districts? (in|of) the province|(creating|constituting) .*(congressional|legislative) district|(another|additional|new|separate|lone) (legislative|congressional) district)"),
    ("holiday", r"(special (non-?working|working) (public )?(holiday|day)|non-?working (public )?holiday|special holiday|working holiday)"),
    ("rename_place", r"(chang(e|es|ing) the names? of (the |certain )?(barrios?|barangays?|municipalit(y|ies)|towns?|province|sitios?|poblacion|islands?|municipal district)\b|"
     r"renam(e|es|ing) (the )?(barrios?|barangays?|municipalit(y|ies)|towns?|province|sitios?|islands?)\b|chang(e|es|ing) the name of [A-Za-zñ .'-]+ (city|province) to|changing the name of the city of)"),
    ("hospital", r"(bed capacity|hospital|chest (center|clinic)|dispensar|medical center|infirmar|sanitari|leprosarium|maternity (and|hospital|home|clinic)|puericulture|health (center|centre|unit|station|office)|rural health|lying-in|dialysis center|"
     r"cancer (center|institute)|heart (center|institute)|kidney (center|institute)|lung center|specialty (center|hospital)|chest clinic|emergency clinic|medical clinic|treatment and rehabilitation center)"),
    ("college", r"(to offer .*(degree|bachelor|curricul|courses leading)|offering of .*(degree|bachelor|curricul)|state (university|college|polytechnic)|polytechnic (university|college|state)|college of (medicine|law|nursing|veterinary)|"
     r"into a (state |chartered |community )?(college|university)|into the [A-Za-z .'-]+ (college|university)\b|(university|college)\b.*\b(campus|extension|annex|satellite|branch)|"
     r"(campus|extension campus|satellite campus|branch campus) of the .*(university|college)|(integrating|merging|converting|elevating|upgrading).*(into|to|as) (a |an |the )?.*(university|college)|"
     r"community college|school of medicine|institute of technology|(national|state) (institute|polytechnic)|\buniversity\b)"),
    ("school", r"(high ?school|elementary school|integrated school|primary school|central school|community school|paaralan|science high\b|national (high school|trade|vocational|agricultural|fishery|comprehensive|school)\b|"
     r"(trade|vocational|agricultural|fishery|fisheries|arts and trades|rural|industrial|farm|normal) (high )?school|school of (arts and trades|fisheries|agriculture)|barrio high|barangay high|community high|"
     r"secondary school|technical(-| )vocational high|agro(-| )industrial (high )?school|pilot school|laboratory school|school for the (deaf|blind)|special education)"),
    ("court", r"(regional trial court|municipal trial court|municipal circuit trial court|metropolitan trial court|court of first instance|municipal court|city court|circuit criminal court|juvenile and domestic|"
     r"family court|shari'?a|court branches|branches of the (regional|municipal)|additional branch|judicial district|court of agrarian|justice of the peace|trial courts?)|municipal judges?|city judges?|position of (municipal |city )?judge"),
    ("lgu", r"(creating (the |a |an )?(new )?(municipalit|city|cities|barangay|barrio|province|town)|creating (certain|two|three|four|five|six|seven|eight|nine|ten|\d+|additional|several|one) (new )?(barangays?|barrios?|municipalit)|"
     r"converting (the )?(municipality|town) of .* (into|to) (a |an )?(component |highly urbanized |independent )?city|into a (component |highly urbanized |independent component )?city|cityhood|charter of the city|city charter|\bcharter\b.*\bcity\b|"
     r"(merging|dividing|annexing|abolishing|consolidating|separating)\s+(?:[\w'.,-]+\s+){0,6}?(barangays?|barrios?|municipalit|sitios?|provinces?\b)|"
     r"constituting .*(into|as) (a |an )?(distinct|separate|independent|regular|new)? ?(barangay|barrio|municipalit)|(transferring|fixing|defining|delineating) .*(seat of government|boundar|territorial)|"
     r"seat of (the )?(municipal|provincial) government|into (a |an )?(distinct and independent|separate|regular|independent) (municipalit|barangay|barrio)|(highly urbanized|component) city|plebiscite|"
     r"(special|chartered) city|subprovince|sub-province|regular province|township)|(to )?(create|creating) (the |a |an )?(barrios?|sitios?|barangays?|municipalit|municipal district)|"
     r"convert(ing)? (the )?sitios? .* into (a )?(barrio|barangay)|transferring (the )?(barrios?|barangays?|sitios?)|(declaring|recognizing) (the existence of )?certain (barrios|barangays)|"
     r"(new )?capital of the province|charter of (the |said )?(city|municipality)|convert(ing)? certain sitios|to create the provinces?|separate the barrios|creating a certain barrio|seat of (the )?government|"
     r"naming the (barrios|barangays)|creation of the (city|municipality|province) of|validating .* creation"),
    ("road", r"(national (road|highway)|(provincial|municipal|barangay|city|farm-to-market|access|circumferential|coastal|diversion|by-?pass) roads?|\broad\b(?! board)|highway|bridge|\bstreets?\b|avenue|boulevard|expressway|causeway|flyover|interchange)"),
    ("college", r"(\bcollege\b|\bcampus\b)"),
    ("school_generic", r"\bschools?\b"),
    ("private_other", r"(granting (a )?(pension|gratuity|life pension)|pension to|gratuity to|(payment|settlement|refund) of (the )?(claim|claims)|claim of|for the relief of|"
     r"exempting the .* from (the payment|taxes|customs)|condoning|to pay (the )?(heirs|widow)|heirs of|widow of|granting (mr\.|mrs\.|miss|dr\.|attorney|atty\.)|authorizing .* to (practice|take the))"),
    ("commemoration", r"(declaring .* (day|week|month|year) (of|in) (every|each) year|(national|international|world) .* (day|week|month)\b|(day|week|month) of (every|each) year|"
     r"national (symbol|flower|tree|bird|animal|fish|dance|song|hero|artist|shrine|gem|language|costume|emblem|anthem|motto|seal|leaf|fruit|house)|"
     r"postage stamps?|centennial|sesquicentennial|national (martial art|sport|game)|(day|week|month) in the entire (country|philippines)|observance of|throughout the entire philippines)"),
    ("holiday", r"(special (non-?working|working) (holiday|day)|non-working holiday|legal holiday|public holiday|holiday in the|founding anniversary|foundation day|charter day|araw ng|festival|fiesta)"),
    ("land", r"(protected (area|landscape|seascape)|natural park|national park|wildlife sanctuary|marine (reserve|sanctuary)|forest reserve|watershed|mangrove|\breservation\b|townsite|parcels? of (public |private )?land|"
     r"(public|government|friar|private|agricultural|foreshore|marshy) lands?|lands? (owned|located|situated|reserved|of the public domain)|(sale|lease|donation|transfer|conveyance|disposition) of (the |certain )?(public )?(lands?|lots?|parcels?|properties|property)|"
     r"\blots? (no|number)|real property|donat(e|ing) .* (land|lot|property)|reclassif|public domain|homestead|cadastral|free patent|reclamation|foreshore|hot spring|mountain|\bmount\b|\bmt\.|lake\b|river\b|falls\b|cave)"),
    ("public_works", PUBLIC_WORKS),
    ("office", r"(district engineering office|engineering district|district office|extension office|satellite office|regional office|provincial office|field office|sub-office|land transportation office|"
     r"bureau of internal revenue|immigration|\blto\b|\bdar\b|\bdti\b|tesda|training (center|centre|institute)|fish port|fishport|seaport|\bport\b|airport|landing|wharf|pier|lighthouse|"
     r"market|slaughterhouse|abattoir|waterworks|water system|irrigation|dam\b|reservoir|power plant|electrification|station|nursery|seed farm|breeding|stock farm|experiment|demonstration farm|"
     r"research (center|station|and development)|hatchery|laboratory|museum|library|sports (complex|center|academy)|coliseum|stadium|gymnasium|park\b|plaza|tourist|tourism|"
     r"eco-?tourism|police|fire (station|district)|jail|prison|penal|detention|drug (rehabilitation|abuse treatment)|post office|postal|telegraph|telephone (system|exchange|office)|radio station of the|"
     r"cemetery|monument|shrine|historical|landmark|center for|centre for|hall of|convention center|provincial (fiscal|assessor|treasurer|auditor|engineer)|assistant (provincial|city) fiscal|city fiscal|"
     r"economic zone|ecozone|freeport|special economic|industrial estate|export processing|development authority|authority|commission on|board of|council of|office of|agency|bureau)|shrine"),
]

ACTIONS = [
    ("increase", "increas"), ("separate", "separat"), ("convert", "convert"), ("upgrade", "upgrad"), ("rename", "(renam|chang(e|es|ing) the name)"), ("establish", "establish"),
    ("create", "creat"), ("renew", "renew"), ("grant", "grant"), ("declare", "declar"), ("amend", "amend"), ("integrate", "integrat"), ("merge", "merg"), ("divide", "divid"),
    ("transfer", "transfer"), ("appropriate", "appropriat"),
]

BED_WORDS = {
    "ten": 10, "fifteen": 15, "twenty": 20, "twenty-five": 25, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "seventy-five": 75, "eighty": 80, "ninety": 90,
    "one hundred": 100, "one hundred fifty": 150, "two hundred": 200, "two hundred fifty": 250, "three hundred": 300, "four hundred": 400, "five hundred": 500, "six hundred": 600,
    "seven hundred": 700, "eight hundred": 800, "one thousand": 1000, "one thousand five hundred": 1500, "two thousand": 2000,
}
BEDS = r"(?iU)from\s+(?:([a-z\- ]+?)\s*)?\(?\s*([0-9,]+)?\s*\)?\s*(?:beds?\s+)?to\s+(?:([a-z\- ]+?)\s*)?\(?\s*([0-9,]+)?\s*\)?\s*beds?"
KNOWN_AS = (
    r"(?iU)(?:to be known|shall be known|hereafter known|henceforth known|to be called|as the)\s+(?:as\s+)?(?:the\s+)?"
    r"(.+?)(?=,|\s+and\s+(?:appropriating|authorizing|providing|for other)|\s+appropriating|\s+in the (?:barangay|municipality|city|province)|$)"
)
CHANGE_TO = r"(?U)\bto\s+(?:the\s+)?([A-Z][^,]*?(?:School|Hospital|Center|University|College|Campus|Road|Highway|Bridge|Street|Avenue))\b"

# --- logic -------------------------------------------------------------------

_IGNORE = "(?iU)"


def category(title: Column) -> Column:
    """Kind of an act by the first rule whose guard holds; rows whose guard fails fall through."""
    return bound(squeeze(title), lambda t: bound(_first_rule(t), lambda found: _checked(t, found)))


def _first_rule(t: Column) -> Column:
    place = t.rlike(SPECIFIC_PLACE)
    cited = referenced_acts(F.when(t.rlike(_IGNORE + PUBLIC_WORKS), t))
    item = ~t.rlike(_IGNORE + r"\bbonds?\b") & (
        F.coalesce(F.arrays_overlap(cited, F.array(*[F.lit(n) for n in PUBLIC_WORKS_ACTS])), F.lit(False)) | t.rlike(_IGNORE + "public works") | t.rlike(rf"(?U)\b(?:{_PROVINCE})\b") | place
    )
    guards = {"office": place, "land": place, "school_generic": place, "rename_place": ~t.rlike(_IGNORE + FACILITY), "public_works": item}
    names = {"school_generic": "school", "office_specific": "office"}
    return first_match(t, [Rule(names.get(k, k), _IGNORE + p, guards.get(k)) for k, p in RULE_PATTERNS])


def _checked(t: Column, found: Column) -> Column:
    """The kind that the first rule gave, put right by what else the title says."""
    place = t.rlike(SPECIFIC_PLACE)
    local = found.isin(*[k for k, s in SCOPES.items() if s == "local"])
    changed = ladder(
        [
            (found.isNull() & place & ~t.rlike(_IGNORE + NATIONAL_HINT), "other_local"),
            (found.isNull(), "national"),
            ((found == "lgu") & ~place & t.rlike(_IGNORE + r"local government code|republic act no\.? 7160"), "national"),
            (local & t.rlike(_IGNORE + EVERYWHERE) & ~place, "national"),
            ((found == "commemoration") & place & ~t.rlike(_IGNORE + r"\b(national|philippine|international|world)\b"), "holiday"),
        ]
    )
    return F.coalesce(changed, found)


def scope(kind: Column) -> Column:
    """local, private or national."""
    return F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair])[kind]


def action(title: Column) -> Column:
    """What the act does: the verb that opens the title, else the first verb of its list found near the beginning."""

    def verb(head: Column) -> Column:
        opening = first_match(head, [Rule(a, r"(?U)^\s*" + p) for a, p in ACTIONS])
        return F.coalesce(opening, first_match(head, [Rule(a, r"(?U)\b" + p) for a, p in ACTIONS]), F.lit("other"))

    return bound(F.lower(F.substring(F.regexp_replace(F.trim(title), r"(?i)^(an?|the)\s+act\s+(to\s+)?", ""), 1, 60)), verb)


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def facility(title: Column, kind: Column) -> Column:
    """The name that a facility gets, if the title says so."""
    known = _found(title, KNOWN_AS, 1)
    changed = F.trim(_found(title, CHANGE_TO, 1))
    return F.coalesce(F.when(F.length(known) > 4, F.regexp_replace(known, "^[ .\"']+|[ .\"']+$", "")), F.when(kind.isin("school", "hospital", "college", "road"), changed))


def beds(title: Column) -> Column:
    """struct(``from``, ``to``): numbers of beds, figures before words."""
    words = F.create_map(*[F.lit(x) for pair in BED_WORDS.items() for x in pair])

    def number(word: int, figure: int) -> Column:
        digits = F.regexp_replace(_found(title, BEDS, figure), ",", "").try_cast("int")
        return F.coalesce(digits, words[F.lower(F.trim(F.regexp_extract(title, BEDS, word)))])

    return F.struct(number(1, 2).alias("from"), number(3, 4).alias("to"))


def classify(acts: DataFrame) -> DataFrame:
    """Acts (with ``title``) with ``category``, ``scope``, ``action``, ``facility``, ``beds_from``, ``beds_to``."""
    out = acts.withColumn("category", category(F.col("title")))
    out = out.withColumns({"scope": scope(F.col("category")), "action": action(F.col("title")), "facility": facility(F.col("title"), F.col("category")), "_beds": beds(F.col("title"))})
    hospital = F.col("category") == "hospital"
    return out.withColumns({"beds_from": F.when(hospital, F.col("_beds.from")), "beds_to": F.when(hospital, F.col("_beds.to"))}).drop("_beds")


def congress_of(day: Column) -> Column:
    """The Congress of a date; after a term's end the one that just closed."""
    return intervals.term_or_last(day, CONGRESSES)


def president_of(day: Column) -> Column:
    """Who was president: half-open terms, null in the gaps between them."""
    return intervals.term_of(day, PRESIDENTS, closed=False)
