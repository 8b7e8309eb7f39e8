"""Labels to train on: distantly supervised places of a sample, and sentences made up with known places.

Nothing here is used when texts are searched; the random field alone decides
there.  In a sample text, e-mail syntax, public numbering plans with the
words that name such numbers, written forms of addresses, and names in mail
headers, signatures, title blocks or after titles and verbs of signing are
labelled.  Words of such names make a dictionary; names made of its words are
labelled wherever they stand in the sample, which is how their other
surroundings are learnt.  Forms that are not settled (a number without a word
that names it, capitalised words of unknown kind) are left out of training.

The sentences made up are of everyday kinds in English, German and Chinese;
their names, towns and numbers are drawn from lists and rules, so the field
sees names and surroundings that the sample lacks.
"""

from __future__ import annotations

import random
import re
from collections import Counter

KINDS = ("person", "email", "phone", "identity", "address")

# Words that the written forms of addresses and names are made of.
STREET_TYPES = (
    "Street St Road Rd Avenue Ave Lane Ln Close Court Ct Boulevard Blvd Drive Dr Way Place Pl Terrace Crescent Square Sq Row Walk Hill Parade Quay Mews"
).split()
UNITS = "Suite Apt Apartment Unit Flat Room Floor Rm Ste".split()
PARTICLES = "van von der den de di da del la le ten ter zu".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Sir Mme".split()
#: Frequent given and family names of several languages, and family names in Chinese characters.
GIVEN = (
    "James Mary John Linda Robert Susan Michael Sarah David Karen William Nancy Thomas Emma Daniel Olivia Peter Sophie Paul Julia Mark Anna George Laura Kevin Maria Brian Helen Edward Alice Henry Ruth "
    "Hans Ursula Klaus Petra Jürgen Sabine Wolfgang Monika Stefan Heike Dieter Birgit Uwe Katrin Matthias Ingrid José Carmen Luis Pilar Jean Pierre Claire Luc Élodie Giulia Marco Paolo Ivan Olga Sergei Natalia "
    "Ahmed Fatima Omar Leila Yusuf Aisha Raj Anita Vikram Sunita Kenji Yuki Haruto Sakura Wei Jing Min Ji-woo Kwame Ama Chidi Ngozi Bjørn Astrid Lars Ingeborg Mikael Tuula Zofia Piotr Agnieszka Jan"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Walker Hall Young King Wright Green Baker Adams Nelson Carter Mitchell Roberts "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann García López Martínez Rodríguez Dubois Laurent Moreau Rossi Ferrari Bianchi "
    "Ivanov Petrov Novák Kowalski Nowak Horváth Larsen Hansen Johansson Korhonen Khan Singh Patel Sharma Gupta Tanaka Suzuki Yamamoto Kim Park Nguyen Okafor Mensah Haddad O'Brien O'Connor MacDonald"
).split()
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂文辉玲志建国华梅鑫宇浩欣怡雨泽梓涵子轩思远晓云嘉俊凯琳雪婷佳慧悦安宁诗然"

#: Function words of English and German, which are common words also where a text only begins with them.
FUNCTION_WORDS = (
    "the a an and or but if of to in on at by for from with as is are was were be been this that these those it its he she they we you i his her their our your my not no so than then there here who what which when where why how all any both each "
    "der die das ein eine einer eines einem einen und oder aber wenn von zu im in am an auf bei für mit als ist sind war waren sein dies diese dieser dieses es er sie wir ihr ich nicht kein keine so dann dort hier wer was welche wann wo warum wie alle jede zur zum vom beim nach vor über unter laut"
).split()

_NOT_IN_WORD = r"(?<![A-Za-z0-9_À-ɏ])"
_END = r"(?![A-Za-z0-9_À-ɏ])"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
# Reserved and frequent top-level names, which end an address even where text follows without a blank.
_TOP = rf"(?:(?i:example|invalid|test|com|org|net|info|edu|gov)(?![a-z-])|[A-Za-z]{{2,}}{_END})"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?)(?:{_LABEL}{_DOT})+{_TOP}"
    rf"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*\sat\s(?:{_LABEL}(?:\sdot\s|\s?\[dot\]\s?))+{_TOP}"
    rf"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9]*[._+-][A-Za-z0-9._%+-]*\sat\s(?:{_LABEL}\.)+{_TOP}"
)
# Public numbering plans: country code, North American, British, German and Chinese forms.
_STICKS = r"[a-z0-9_]|[A-Z](?![A-Z]{0,2}[0-9])"
_S = r"[ .\-/]?"
_COUNTRY = r"(?:(?:\+|00)[1-9][0-9]{0,2}[ .\-]?)"
PHONE = re.compile(
    rf"(?<![A-Za-z0-9_+.,-])(?:"
    rf"{_COUNTRY}?\([2-9][0-9]{{2}}\)\s?[0-9]{{3}}[ .-]?[0-9]{{4}}"
    rf"|{_COUNTRY}\(0\)\s?[0-9]{{1,4}}{_S}[0-9]{{2,8}}(?:{_S}[0-9]{{1,6}}){{0,3}}"
    rf"|(?:\+1[ .-]?|1[ .-]?)?[2-9][0-9]{{2}}[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}"
    rf"|{_COUNTRY}[0-9]{{1,5}}(?:[ .\-/][0-9]{{2,8}}){{0,4}}"
    rf"|(?:\+|00)[1-9][0-9]{{9,13}}"
    rf"|\(?0[1-9][0-9]{{1,4}}\)?[ /-][0-9]{{3,8}}(?:[ -][0-9]{{2,6}}){{0,3}}"
    rf"|0[1-9](?:[ .-]?[0-9]{{2}}){{4}}"
    rf"|0[1-9][0-9]{{8,10}}"
    rf"|1[3-9][0-9](?:[ -]?[0-9]{{4}}){{2}}"
    rf"|0[0-9]{{2}} [0-9]{{4}} [0-9]{{4}}"
    rf")(?!{_STICKS}|[.,-][0-9]|-[A-Z])"
)
# Public forms: Chinese resident number (with its check digit), 3-2-4 and nine digits, British insurance number, passports.
RESIDENT = re.compile(r"(?<![A-Za-z0-9_.,+/#-])[1-9][0-9]{5}\s?(?:19|20)[0-9]{6}\s?[0-9]{3}[0-9Xx](?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?<![A-Za-z0-9_.,+/#-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![a-z0-9_]|-[A-Z0-9])")
INSURANCE = re.compile(r"(?<![A-Za-z0-9_{])[A-Z]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-D](?![A-Za-z0-9])")
PASSPORT = re.compile(r"(?<![A-Za-z0-9_{.,+/#-])(?:[A-Z]{1,2}\s?[0-9]{7,8}|[0-9]{9})(?![A-Za-z0-9]|-[A-Z0-9])")
# Words that name numbers of persons, numbers to call, and numbers of things.
NAMES_IDENTITY = re.compile(r"(?i:\b(?:ssn|social|insurance|identity|id|nin|ni|personal|passport|pass|ausweis|reisepass|personalausweis|versicherungsnummer|card)\b|证|护照)[^\n]{0,18}$")
NAMES_PHONE = re.compile(r"(?i:\b(?:tel|phone|telefon|fon|fax|mobile|mobil|cell|call|ring|dial|ruf|reach|text)\b|电话|手机|拨打|致电|联系)[^\n]{0,14}$")
NAMES_THING = re.compile(r"(?i:\b(?:pages?|elevation|tag|item|stack|row|coordinates?|trace|heat|serial|batch|lot|order|part|drawing|line|invoice|revision)\b|编号|炉号|批号|页码|标高)[^\n]{0,12}$")
BESIDE = re.compile(r"\s?[,;:(|]\s?\Z|\s[a-zß-ɏ]+\s\Z")

_SEP = r"(?:,[ \t]*\n?(?:> ?)?[ \t]*|[ \t]*\n(?:> ?)?[ \t]*)"
_POST = r"(?:(?i:[A-Z]{1,2}[0-9][0-9A-Z]?\s[0-9][A-Z]{2})|[0-9]{5}(?:-[0-9]{4})?)"


def _town(word: str, end: str = "") -> str:
    return rf"(?:{word}(?:[ ]{word})?,?\s{_POST}\b|{word}(?:[ ]{word})?{end})"


_TOWN = rf"(?:{_SEP}(?:{_town(r"[A-ZÀ-Þ][a-zß-ɏ'-]{2,}")}|{_town(r"[A-ZÀ-Þ][A-ZÀ-Þ'-]{3,}")}|{_town(r"[a-zß-ɏ'-]{3,}", r"(?=[,.;。，\n]|$)")}))"
_TYPES = "|".join(sorted(STREET_TYPES, key=len, reverse=True))
_UNIT = rf"(?:(?i:{'|'.join(UNITS)})\.?\s#?[0-9]+[A-Za-z]?,\s*)"
ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_À-ɏ.,+-])(?:"
    rf"{_UNIT}?[0-9]{{1,5}}[A-Za-z]?\s(?!in\s|of\s|on\s|at\s)(?:[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ'-]*[ ]){{1,3}}(?<!\sa[ ])(?i:{_TYPES})(?:\.|\b)"
    rf"{_TOWN}?"
    rf"|(?i:P\.?\s?O\.?\s?Box)\s[0-9]+{_TOWN}?"
    rf"|(?:(?:[A-ZÄÖÜ][a-zäöüß]+er[ ])?(?:[A-ZÄÖÜ][A-Za-zäöüß]*(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Ww]eg|[Pp]latz|[Gg]asse|[Aa]llee|[Rr]ain|[Rr]ing|[Uu]fer|[Dd]amm|[Hh]of|[Ss]teig|[Mm]arkt))"
    rf"|(?:Am|An der|Im|Auf der|Zum|Zur)\s[A-ZÄÖÜ][a-zäöüß]+)\s[0-9]{{1,4}}\s?[a-z]?,\s*\n?(?:> ?)?[0-9]{{5}}\s[A-ZÄÖÜ][A-Za-zäöüß-]+(?:\s(?:am\s)?[A-ZÄÖÜ][a-zäöüß]+)?"
    r")"
    r"|(?:(?<![一-鿿])[一-鿿]{3}[市县]|[一-鿿]{2}[市县])(?:[一-鿿]{2,3}[区镇])?[一-鿿]{1,6}?(?:大道|路|街|巷|道|弄)[0-9]{1,5}号(?:[0-9]{1,4}(?:栋|幢|号楼|座))?(?:[0-9]{1,3}单元)?(?:[0-9]{1,5}(?:室|房)?)?"
)

_W = r"(?:[A-ZÀ-Þ][a-zß-ɏ]+|[A-ZÀ-Þ]['][A-ZÀ-Þ][a-zß-ɏ]+|Mac[A-Z][a-z]+)"
_U = r"(?:[A-ZÀ-Þ]{2,}|[A-ZÀ-Þ]['][A-ZÀ-Þ]+)"
_L = r"(?:[a-zß-ɏ]+|[a-z]['][a-zß-ɏ]+)"


def _name(word: str, particle: str, initial: str) -> str:
    one = rf"{word}(?:-{word})?"
    gap = r"(?:[ \t]+|[ \t]*\n(?:> ?)?)"
    family = rf"(?:(?:{particle}){gap})*{one}"
    return rf"(?:{family},{gap}(?:{one}|{initial})|(?:{one}|{initial})(?:{gap}{initial})*{gap}{family})"


_PART = "|".join(PARTICLES)
_MIXED = rf"(?:(?:{_PART.upper()})[ ])*{_U}(?:-{_U})?,[ ](?:{_W}(?:-{_W})?|[A-ZÀ-Þ][.])"
NAME = rf"(?:{_MIXED}|{_name(_W, _PART, r'[A-ZÀ-Þ][.]')}|{_name(_U, _PART.upper(), r'[A-ZÀ-Þ][.]')})"
LOOSE_NAME = rf"(?:{NAME}|{_name(_L, _PART, r'[a-z][.]')})"
_NAME_END = r"(?![A-Za-z0-9_À-ɏ@-])"
#: A name by its case; overlapping ones are tried from every word on.
SHAPED = re.compile(rf"(?<![A-Za-z0-9_À-ɏ@.-])(?=(?P<name>{LOOSE_NAME}){_NAME_END})")
# Titles, verbs of signing, mail headers, closings and title-block fields.
_CUES = (
    r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau)\.?\s|(?i:\b(?:signed|checked|cleared|approved|drawn|reviewed|prepared|verified|written|inspected|issued|countersigned))\s(?i:by):?\s"
    r"|(?:[Gg]eprüft|[Ff]reigegeben|[Gg]ezeichnet|[Ee]rstellt|[Gg]enehmigt)\svon:?\s|\b(?:DRN|CHK|APP|DRAWN|CHECKED)\sBY:?\s|(?:^|[\n\s])(?:From|To|Cc|Bcc|Von|An|Attention|Attn):?\s"
    r"|Author=|\"author\":\s?\"|(?:[Rr]egards|Grüßen|Cheers|Best|Thanks|Sincerely),?\n|-- ?\n|\b(?:checker|designer|inspector|welder|author|drawn)\s?[|:]\s|(?:设计|校对|审核|检查|签名|抄送)\s?[|:]\s?|联系人:?"
)
CUED = re.compile(rf"(?:{_CUES})(?P<name>{LOOSE_NAME}){_NAME_END}")
#: A name that a number to call or a mail address follows at once.
REACHED = re.compile(rf"(?<![A-Za-z0-9_À-ɏ@.-])(?P<name>{NAME})(?=\s?(?:,\s)?(?:<|\((?:\+|0|mail)|Tel\b|,\sTel\b))")
HAN_CUED = re.compile(r"(?:签名:\n?|联系人:?|抄送:|(?:设计|校对|审核|检查) ?[|:] ?)(?P<name>[一-鿿]{2,4})(?=[,。;!.\n |、(<]|$)")
PLAIN_WORD = re.compile(r"(?<![A-Za-z0-9._+@À-ɏ-])[A-Za-zÀ-ɏ]{2,}(?![A-Za-z0-9_+@À-ɏ]|[.-][A-Za-z0-9])")
_WORDS = re.compile(r"[A-Za-zÀ-ɏ]{2,}")


def common_words(texts: list[str], least: int = 3) -> set[str]:
    """Words that mostly stand in lower case."""
    lower, total = Counter(), Counter()
    for text in texts:
        for w in PLAIN_WORD.findall(text):
            total[w.lower()] += 1
            lower[w.lower()] += w.islower()
    return {w for w, n in total.items() if n >= least and lower[w] > 0.5 * n} | (set(FUNCTION_WORDS) - set(PARTICLES))


class NameWords:
    """Words of the names that their surroundings tell, over a sample."""

    def __init__(self, texts: list[str], common: set[str]):
        latin, self.han_family, han_given = Counter(), set(), Counter()
        self.common = common
        for text in texts:
            for m in [*CUED.finditer(text), *REACHED.finditer(text)]:
                words = self._parts(m.group("name"))
                if words and not any(w in common for w in words):
                    latin.update(words)
            for m in HAN_CUED.finditer(text):
                name = m.group("name")
                cut = 2 if len(name) == 4 else 1
                han_given[name[cut:]] += 1
                self.han_family.add(name[:cut])
        self.latin = {w for w, n in latin.items() if n >= 2}
        given = sorted((g for g, n in han_given.items() if n >= 2), key=len, reverse=True)
        family = sorted(self.han_family, key=len, reverse=True)
        self.han = re.compile(f"(?:{'|'.join(family)})(?:{'|'.join(given)})") if family and given else None

    @staticmethod
    def _parts(name: str) -> list[str]:
        return [w.lower() for w in _WORDS.findall(name) if w.lower() not in PARTICLES]

    def names(self, text: str) -> list[tuple[int, int]]:
        """Names all of whose words are known."""
        out, last = [], 0
        for m in SHAPED.finditer(text):
            s, e = m.span("name")
            if s >= last and (words := self._parts(text[s:e])) and all(w in self.latin for w in words):
                out.append((s, e))
                last = e
        if self.han:
            out += [m.span() for m in self.han.finditer(text)]
        return out


def _resident_is_valid(digits: str) -> bool:
    values = [10 if c in "Xx" else int(c) for c in digits if not c.isspace()]
    return sum(d * pow(2, 17 - i, 11) for i, d in enumerate(values)) % 11 == 1


def weak_labels(text: str, words: NameWords) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(places, spans that are not settled) of a folded text; places do not overlap."""
    before = lambda s: text[max(0, s - 24) : s]
    found, open_ = [("email", *m.span()) for m in EMAIL.finditer(text)], []
    cued = [m.span("name") for p in (CUED, REACHED, HAN_CUED) for m in p.finditer(text)]
    cued = [(s, e) for s, e in cued if not any(w in words.common for w in words._parts(text[s:e]))]
    people = sorted(cued + words.names(text), key=lambda x: (x[0], -x[1]))
    ends = [e for _, e in people]

    def beside_a_name(s: int) -> bool:
        """Whether a name ends right before, over a sign or one word."""
        return any(e < s <= e + 14 and BESIDE.match(text[e:s]) for e in ends)

    def decide(kind: str, s: int, e: int, sure: bool) -> None:
        if NAMES_THING.search(before(s)):
            return
        if sure:
            found.append((kind, s, e))
        else:
            open_.append((s, e))

    for m in RESIDENT.finditer(text):
        decide("identity", *m.span(), _resident_is_valid(m.group()) or bool(NAMES_IDENTITY.search(before(m.start()))) or beside_a_name(m.start()))
    for m in SOCIAL.finditer(text):
        decide("identity", *m.span(), True)
    for m in INSURANCE.finditer(text):
        decide("identity", *m.span(), True)
    for m in PASSPORT.finditer(text):
        decide("identity", *m.span(), bool(NAMES_IDENTITY.search(before(m.start()))) or beside_a_name(m.start()))
    for m in PHONE.finditer(text):
        form = m.group()
        told = form[0] in "+(0" or bool(re.search(r"[^0-9]", form)) or bool(NAMES_PHONE.search(before(m.start())))
        if 7 <= sum(c.isdigit() for c in form) <= 15:
            decide("phone", *m.span(), told)
    for m in ADDRESS.finditer(text):
        s, e = m.span()
        while e > s and text[e - 1] in " \t\n,;:":
            e -= 1
        found.append(("address", s, e))
    for s, e in people:
        found.append(("person", s, e))
    taken: list[tuple[str, int, int]] = []
    for kind, s, e in found:
        if s < e and not any(a < e and s < b for _, a, b in taken):
            taken.append((kind, s, e))
    # Capitalised words of unknown kind are not settled.
    for m in SHAPED.finditer(text):
        s, e = m.span("name")
        parts = words._parts(text[s:e])
        if text[s].isupper() and parts and not any(w in words.common for w in parts) and not any(a < e and s < b for _, a, b in taken):
            open_.append((s, e))
    return sorted(taken, key=lambda x: x[1]), [x for x in open_ if not any(a < x[1] and x[0] < b for _, a, b in taken)]


# Sentences of everyday kinds; a brace names what stands in its place.
ENGLISH = (
    "{person} called about the invoice this morning.", "Please send the contract to {email} before noon.", "You can reach {person} at {phone} after five.", "I met {person} in the lobby and we talked for an hour.",
    "Our new colleague {person} starts next week.", "{person} wrote the report, and {person} read it twice.", "The parcel goes to {address}, second door on the left.", "My number is {phone}; leave a message.",
    "Her social security number is {identity}.", "Passport no. {identity} expires in May.", "National insurance number: {identity}", "The meeting with {person} has been moved to Thursday.", "Ask {person} whether the key still fits.",
    "{person} lives at {address}.", "Write to me: {email}", "Ring {phone} or mail {email}.", "Dear {person}, thank you for your letter.", "Kind regards,\n{person}\n{address}\n{phone}", "It was {person} who found the mistake.",
    "Nobody but {person} knew the code.", "{person} and {person} agreed on the price.", "The form was filled in by {person} ({identity}).", "Contact: {person}, {phone}, {email}", "Invoice for {person}, {address}.",
    "The visitor gave the name {person} and the number {identity}.", "{person} said that the pump runs again.", "We owe {person} an answer.", "{person}'s desk is empty.", "Yesterday {person} was ill.", "According to {person} the road is closed.",
    "He moved to {address} last spring.", "Fax {phone}", "Driver {person}, mobile {phone}", "identity card {identity}", "The old address {address} is no longer valid.", "{person} <{email}>", "Could {person} look at this today?", "as {person} pointed out, the {thing} leaks",
    "passport {identity} was stolen in March", "The clerk copied {identity} into the ledger.", "Behind the counter sat {person} with a pencil.", "Last winter {person} painted the fence.", "We never heard from {person} again.", "My aunt {person} bakes bread on Sundays.", "The choir thanked {person} and went home.",
    "Perhaps {person} forgot the umbrella.", "Whoever saw {person} should tell the guard.", "The song was written by {person} in one evening.", "Both {person} and the cook were late.", "Only {person} can open the safe.", "She married {person} in a small chapel.", "{person} grows tomatoes behind the shed.", "The doctor examined {person} for a long time.",
    "For years {person} repaired clocks.", "The jury believed {person}.", "Engineer {person} explained the drawing.", "A postcard from {person} lay on the mat.", "Use {phone} at night.", "The shop at {address} sells lamps.", "Their house, {address}, burned down.", "Reply to {email} by Friday.", "The bill was sent to {address} twice.",
    "Chapter Nine describes how glaciers move.", "Central Station was empty, so the band went home.", "The Golden Harvest festival draws large crowds.", "Blue Ridge apples taste sweet.", "Great Lakes shipping resumed slowly.", "Several farmers planted cherries near the creek.", "A gentle breeze moved the curtains while children slept.", "Nobody expected such heavy rain during harvest.",
    "Old bridges rust quickly near salt water.", "Twelve wagons carried timber across the valley.", "The museum displays ancient coins beside painted vases.", "Clever foxes avoid noisy roads.", "Her garden contains tulips, roses and a crooked pear tree.",
    "The {trade} pump runs quietly.", "Order number {plain} was shipped on {date}.", "{trade} valves come in three sizes.", "Part {plain}, quantity 12.", "The {trade} company sells bolts.", "Serial number {code} is stamped on the plate.",
    "Room 12 is closed on {date}.", "Page 3 of 17 shows the {thing}.", "The {thing} weighs 12.5 kg and costs 300.", "Item {plain} is out of stock.", "Version 2.14.3 fixes the {thing}.", "Batch {code} passed.", "We need 20 {thing}s in a row.", "Monday Morning Meeting at noon.",
    "Read Chapter Four first.", "The Annual Report is due.", "Heat number {code}", "It measures {number} by {number} mm.", "See Section {number} and Table 4.", "The North Gate stays shut.", "Total {number}, of which {number} paid.", "Tag {code} hangs on the {thing}.",
)
GERMAN = (
    "{person} hat gestern angerufen.", "Bitte den Vertrag an {email} schicken.", "Sie erreichen {person} unter {phone}.", "Ich habe {person} im Flur getroffen.", "{person} wohnt in der {address}.", "Ausweisnummer: {identity}", "Mein Pass hat die Nummer {identity}.",
    "Mit freundlichen Grüßen\n{person}\n{address}", "Wir haben {person} gefragt.", "Laut {person} ist die Straße gesperrt.", "Das Paket geht an {address}.", "Frau {person} kommt später.", "Herr {person} fragt nach dem Schlüssel.", "Telefon {phone}, Fax {phone}", "Ansprechpartner ist {person}, {email}.",
    "Am Fenster stand {person} und las.", "Seit Jahren sammelt {person} Briefmarken.", "Die Uhr gehört {person}.", "Nachts träumt {person} vom Meer.", "Meine Tante {person} backt Brot.", "Niemand kannte {person} besser.", "Vorgestern kam {person} zu spät.", "Der Laden in der {address} verkauft Lampen.",
    "Abends sprach {person} von dem Unfall.", "Im April heiratet {person} von nebenan.", "Der Hund lief {person} bis zur Schule nach.", "Im Juni fährt {person} nach Rom.", "Sogar {person} musste lachen.",
    "Der Chor singt um sieben, anschließend wird getanzt.", "Kinder spielen gern hinter der alten Mühle.", "Große Wolken ziehen über den See.", "Im Winter heizen viele Bauern mit Holz.", "Das Museum zeigt bemalte Vasen und Münzen.", "Der Zug fährt pünktlich nach Norden.", "Zweite Auflage, dritter Band.",
    "Die Rechnung {plain} ist bezahlt.", "Die {trade} Pumpe läuft leise.", "Das Ventil hat die Nummer {code}.", "Auf Seite 12 fehlt das Bild.", "Die Länge beträgt {number} mm.", "Der Bogen liegt neben dem Flansch.", "Am {date} war die Halle zu.", "Posten {plain}, Menge 4.", "Die Zeichnung zeigt den Träger.", "Das Lager hat drei Tore.",
)
CHINESE = (
    "{han}昨天打来电话。", "请把合同发到{email}。", "可以拨打{phone}找{han}。", "我在大厅遇见了{han}。", "新同事{han}下周入职。", "{han}和{han}同意了价格。", "包裹寄到{han_address}。", "身份证号码是{identity}。", "护照{identity}五月到期。", "会议由{han}主持。", "请问{han}钥匙还能用吗?",
    "{han}住在{han_address}。", "电话{phone},邮箱{email}", "收件人{han},{han_address},{phone}", "表格由{han}填写({identity})。", "据{han}说,路已经封了。", "经理{han}签了字。", "{han}先生来过。", "{han}女士的办公桌空着。", "联系人:{han}",
    "老师{han}在黑板上写字。", "{han}买了三斤苹果。", "邻居{han}修好了自行车。", "那幅画出自{han}之手。", "去年{han}搬到了南方。", "医生给{han}开了药。", "大家都喜欢{han}做的菜。", "只有{han}知道密码。", "记者采访了{han}。", "厨师{han}正在休息。", "{han}唱了一首老歌。", "我把伞借给了{han}。", "听说{han}会弹钢琴。", "工程师{han}画了一张草图。", "{han}的邮箱是{email}。", "小店老板{han}今天没开门。",
    "今早{han}在门口等车。", "上个月{han}去了北京。", "下午{han}把书还了。", "这首歌是{han}唱的。", "对面的{han}开了一家店。", "楼上的{han}搬走了。", "经理{han}的电话是{phone}。", "护士{han}带病人去了花园。", "晚上{han}还在加班。", "我和{han}去看了电影。", "{han}拿走了雨伞。", "钥匙在{han}那里。", "学生{han}得了第一名。", "谢谢{han}的帮助。", "那天{han}没有说话。",
    "春天的花园里开满了花。", "火车准时到达北方的小城。", "孩子们在河边玩耍。", "博物馆展出古老的钱币。", "这座桥已经有一百年的历史。", "天气预报说明天有雨。", "市场里的苹果很便宜。", "他们喜欢在山上散步。",
    "订单{plain}已发货。", "第三页少了一张图。", "长度为{number}毫米。", "阀门编号{code}。", "本周没有问题。", "仓库有三个门。", "总数{number},已付{number}。", "请检查法兰和弯头的位置。", "图纸已经重新导出。", "标高与清单不同。", "管线走向需要复核。", "支架编号与位置不符。",
)
TOWNS = "Springfield Riverton Ashford Milbrook Kingsbury Oakdale Fairview Lakewood Harlow Westport Clayton Burford Eastleigh Norwood Marston Hillsborough".split()
TRADES = "Apex Falcon Norden Vulcan Orion Delta Titan Corona Pioneer Summit Crown Atlas Granite Beacon Comet Zenith".split()
THINGS = "pump valve bracket flange ladder gasket boiler cable motor hinge bearing filter".split()
_SYLLABLES = "ba bel bran cal cor dal den dor el en fal far gan gor hal hel il is kar ken lan lor mal mar mon nar nor o pel per quin ra ren ros sal sel ta tor tul ul va ven wil yor za zel".split()
_ENDS = "n r s th ck ld m l ne tt ng rd ske wn ler man field brook wood ton ley ford well".split()


class Maker:
    """Texts with known places, drawn by a seeded generator."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.rng.choice(first) + "".join(self.rng.choice("0123456789") for _ in range(n - 1))

    def word(self) -> str:
        return ("".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.choice([1, 2, 2, 3]))) + self.rng.choice(_ENDS)).capitalize()

    def person(self) -> str:
        r = self.rng
        given = r.choice(GIVEN) if r.random() < 0.5 else self.word()
        family = r.choice(FAMILY) if r.random() < 0.45 else self.word()
        if r.random() < 0.1:
            family += "-" + self.word()
        if r.random() < 0.1:
            family = r.choice(["van ", "von ", "de ", "van der "]) + family
        style = r.random()
        if style < 0.68:
            name = f"{given} {family}"
        elif style < 0.78:
            name = f"{given[0]}. {family}"
        elif style < 0.88:
            name = f"{given} {r.choice('ABCDEGHJKLMPRST')}. {family}"
        else:
            name = f"{family}, {given if r.random() < 0.6 else given[0] + '.'}"
        case = r.random()
        return name.upper() if case < 0.07 else name.lower() if case < 0.11 and "." not in name else name

    def han(self) -> str:
        r = self.rng
        family = r.choice(HAN_FAMILY) if r.random() < 0.75 else chr(r.randrange(0x4E00, 0x9F00))
        return family + "".join(r.choice(HAN_GIVEN) if r.random() < 0.7 else chr(r.randrange(0x4E00, 0x9F00)) for _ in range(r.choice([1, 2, 2, 2])))

    def email(self) -> str:
        r = self.rng
        user = r.choice([f"{self.word()}.{self.word()}", f"{self.word()}{r.randrange(100)}", f"{self.word()[0]}{self.word()}", f"{self.word()}_{self.word()}", f"{self.word()}-{self.word()[0]}", f"{self.word()}+{self.word()}", f"{self.word()[0]}_{self.word()}{r.randrange(100)}"]).lower()
        host, top = self.word().lower() + r.choice(["", "", "-" + self.word().lower(), ".mail"]), r.choice("com org net example test invalid de cn co.uk".split())
        form = r.random()
        if form < 0.12:
            return f"{user} at {host.replace('.', ' dot ')} dot {top.replace('.', ' dot ')}"
        text = f"{user}{r.choice(['@'] * 8 + [' @ ', '(at)', ' [at] '])}{host}.{top}"
        return text.upper() if form > 0.95 else text

    def phone(self) -> str:
        r, d = self.rng, self.digits
        a, b, c = d(3, "23456789"), d(3), d(4)
        s = r.choice("- .")
        return r.choice([
            f"{a}{s}{b}{s}{c}", f"({a}) {b}-{c}", f"+1{s}{a}{s}{b}{s}{c}", f"1{a}{b}{c}", f"+44 {d(4, '127')} {d(3)} {d(3)}", f"0{d(4, '17')} {d(6)}", f"020 {d(4)} {d(4)}", f"+49 {d(2, '23478')} {d(7)}", f"0{d(2, '23478')}/{d(6)}",
            f"+49 (0){d(2, '23478')} {d(5)}-{d(2)}", f"0049 {d(3, '1')} {d(7)}", f"+33 {d(1, '16')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1, '16')} {d(2)} {d(2)} {d(2)} {d(2)}", f"1{d(2, '3578')}{d(8)}", f"1{d(2, '3578')} {d(4)} {d(4)}", f"+86 1{d(2, '3578')} {d(4)} {d(4)}", f"010-{d(8)}", f"0{d(9, '17')}",
            f"+{d(2, '3469')}{d(9, '123')}", f"{a}{b}{c}", f"0{d(4, '17')} {d(3)} {d(3)}", f"030 {d(5)}", f"+1 ({a}) {b}-{c}",
        ])

    def identity(self) -> str:
        r, d = self.rng, self.digits
        body = d(6, "12345678") + r.choice(["19", "20"]) + d(2) + f"{r.randint(1, 12):02d}{r.randint(1, 28):02d}" + d(3)
        check = next(c for c in ("0123456789X" if r.random() < 0.7 else "0123456789x") if _resident_is_valid(body + c))
        pairs = [d(2) for _ in range(3)]
        letters = "".join(r.choice("ABCEGHJKLMNPRSTWXYZ") for _ in range(2))
        return r.choice([
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", body + check, body + check, letters + "".join(pairs) + r.choice("ABCD"), f"{letters} {' '.join(pairs)} {r.choice('ABCD')}", f"{letters[0]}{d(8)}", f"{letters}{d(7)}", d(9), f"{letters[0]}{d(7)}",
        ])

    def town(self) -> str:
        return self.rng.choice(TOWNS) if self.rng.random() < 0.4 else self.word()

    def address(self) -> str:
        r, d = self.rng, self.digits
        number = f"{r.randint(1, 2999)}{r.choice(['', '', '', 'A', 'b'])}"
        style = r.random()
        post = d(5) if r.random() < 0.5 else f"{r.choice('ABCDEGHLMNOPRSTW')}{r.choice(['', 'A', 'N', 'Q'])}{r.randint(1, 29)} {r.randint(1, 9)}{r.choice('ABDEFGHJLNPQRSTUWXYZ')}{r.choice('ABDEFGHJLNPQRSTUWXYZ')}"
        if style < 0.22:
            street = r.choice([f"{self.word()}straße", f"{self.word()}weg", f"{self.word()}str.", f"{self.word()}er Straße", f"Am {self.word()}", f"{self.word()}platz"])
            return f"{street} {r.randint(1, 199)}, {d(5)} {self.town()}"
        if style < 0.3:
            return f"PO Box {d(3)}, {self.town()}"
        if style < 0.38:
            return f"{r.randint(1, 99)} {r.choice(['rue de', 'avenue de', 'place de'])} {self.word()}, {d(5)} {self.town()}"
        street = f"{self.word()}{' ' + self.word() if r.random() < 0.25 else ''} {r.choice(STREET_TYPES)}"
        unit = f"{r.choice(UNITS)} {r.randint(1, 99)}, " if r.random() < 0.25 else ""
        end = r.random()
        place = "" if end < 0.15 else f"{r.choice([', ', ', ', chr(10)])}{self.town()}" + ("" if end < 0.45 else f" {post}")
        text = f"{unit}{number} {street}{place}"
        return text.lower() if r.random() < 0.06 else text

    def han_address(self) -> str:
        r = self.rng
        one = lambda n: "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n))
        tail = r.choice(["", "", f"{r.randint(1, 30)}栋{r.randint(1, 2000)}室", f"{r.randint(1, 9)}单元{r.randint(1, 2000)}", f"{r.randint(1, 2000)}室"])
        return f"{one(2)}{r.choice('市县')}{r.choice(['', '', one(2) + '区'])}{one(2)}{r.choice(['路', '街', '大道', '巷', '东路', '南路'])}{r.randint(1, 999)}号{tail}"

    def filler(self, kind: str) -> str:
        r = self.rng
        if kind == "trade":
            return r.choice([r.choice(TRADES), r.choice(FAMILY), self.word(), f"{r.choice(TRADES)} {r.choice(['Compact', 'Plus', 'Classic'])}"])
        if kind == "thing":
            return r.choice(THINGS)
        if kind == "plain":
            return self.digits(r.choice([5, 6, 8, 9, 9, 10, 12, 18]), "123456789")
        if kind == "code":
            return r.choice([f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}-{r.choice('ABK')}", f"{r.choice('ABWX')}{self.digits(4)}", f"{self.digits(3)}-{self.digits(4)}-A", f"{r.choice('XYZ')}{self.digits(6)}-{self.digits(2)}"])
        if kind == "date":
            return f"20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
        return f"{r.randint(1, 90000)}{r.choice(['', f'.{r.randint(0, 999)}'])}"

    def text(self) -> tuple[str, list[tuple[str, int, int]]]:
        """A few sentences and the places in them; a person may be named again further down."""
        r = self.rng
        language = r.choice([ENGLISH, ENGLISH, ENGLISH, GERMAN, GERMAN, CHINESE, CHINESE, CHINESE])
        text, places, named = "", [], []
        for _ in range(r.randint(1, 4)):
            for k, piece in enumerate(re.split(r"\{(\w+)\}", r.choice(language))):
                if k % 2 == 0:
                    text += piece
                elif piece in ("trade", "thing", "plain", "code", "date", "number"):
                    text += self.filler(piece)
                else:
                    value = r.choice(named) if named and piece in ("person", "han") and r.random() < 0.3 else getattr(self, piece)()
                    if piece in ("person", "han"):
                        named.append(value)
                    kind = {"han": "person", "han_address": "address"}.get(piece, piece)
                    places.append((kind, len(text), len(text) + len(value)))
                    text += value
            text += "" if language is CHINESE and r.random() < 0.6 else r.choice([" ", " ", "\n"])
        return text, places
