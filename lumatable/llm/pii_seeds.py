"""Invented sentences with known personal details, to be put into sampled texts, so that labels come from how a sentence was made.

People, details and frames are made up and drawn at random; given names are half from a list of names that the generators do not
know. Decoys look like details and are none: places, firms, prizes, devices, numbers of orders and files.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

# Given names beyond the generators' list, parts of family names, and the words and frames that sentences are made of.
OTHER_GIVEN = (
    "Abena", "Adjoa", "Agnieszka", "Aino", "Alessio", "Amara", "Ananya", "Arjun", "Baptiste", "Bogdan", "Chidi", "Chinwe", "Dmitri", "Dov", "Eero", "Eitan", "Endre", "Ewa", "Farid", "Gaëlle",
    "Hiroshi", "Ildikó", "Ilinca", "Inês", "Itziar", "Jelena", "Joaquín", "Jussi", "Khadija", "Kjell", "Kwame", "Leyla", "Linh", "Ludovica", "Luísa", "Maëlle", "Matteo", "Minh", "Mirela", "Noa",
    "Nomvula", "Nuria", "Oksana", "Pavol", "Radu", "Ragnhild", "Rashid", "Réka", "Rui", "Sakura", "Samira", "Sanna", "Sindre", "Solveig", "Tariq", "Thiago", "Thibault", "Thulani", "Valentina", "Vesna",
    "Xabier", "Yael", "Zbigniew", "Zlatko", "Zuzana",
)
SUR_STARTS = ("Bar", "Hol", "Mer", "Kol", "Var", "Sten", "Lind", "Tor", "Fen", "Gal", "Ros", "Dal", "Ber", "Kra", "Oso", "Adi", "Nak", "Pet", "Iv", "Szo", "Mbe", "Quar", "Øst", "Čer", "Zam", "Wel")
SUR_ENDS = ("berg", "mann", "ski", "son", "ova", "ini", "escu", "ez", "ard", "wick", "dottir", "enko", "adze", "amoto", "wala", "kar", "ić", "sen", "aux", "eira", "lund", "hoff", "ela", "anga")
SUR_PARTS = ("van ", "von ", "de la ", "O'", "Mac", "d'", "ben ", "di ")
PLACES = (
    "Amber Heath", "Old Harbour", "Castle Rise", "Nether Wold", "Saint Orlan", "Port Venn", "North Quay", "Upper Marl", "Lake Tilden", "Mount Corrin", "Villa Serena", "Monte Alto", "Bad Lindau", "Groß Elmen",
    "Val Doré", "Puerto Hondo", "Tidewell", "Ostrand", "Karlsbeck", "Belcourt", "Rivas Altas", "Stone Ferry", "Mill Lane", "Harrow Green", "Weir Bridge", "Lower Market",
)
DEVICES = ("Vexar Pro", "Orlin Field", "Tarn Compact", "Quill Mk", "Zenro Alpha", "Lumo Air", "Brant Tele", "Sable Zoom")
FIRM_WORDS = ("Atelier", "Studio", "Galerie", "Redaktion", "Bildredaktion", "Agence", "Estudio", "Maison", "Foto", "Bureau", "Labor", "Archiv")
FIRMS = ("Halden Optik", "Northlight Collective", "Atelier Soleil", "Bright Frame", "Casa Luz", "Grain Press", "Silver Tray Lab")
GOOD = {
    "en": (
        "{n} carried the reflector all afternoon.", "Last week {n} brought the spare lenses.", "The tripod belongs to {n}.", "We owe the idea to {n}.", "Later {n} walked back to the car.", "Ask {n} about the missing card.",
        "{n} will collect the prints soon.", "Sitting on the bench is {n}.", "{n}'s wedding gallery is online.", "The girl in the blue coat is {n}.", "A letter from {n} arrived.", "Please credit {n} for the cover.",
        "Portrait session with {n}, window light.", "Invoice for {n}, two retouches.", "Mrs {n} asked for a larger print.", "Dr. {n} opened the show.", "© {n} 2019", "(photo {n})", "In the middle stands {n}, smiling.",
        "The release was returned by {n} yesterday.", "Many thanks to {n} for the chairs.", "Names: {n} and {n}.", "{n} and {n} held the ladder.", "Caption as given: {n}. The rest is cropped.", "please call {n} before noon", "Yesterday {n} came along.", "Afterwards {n} locked the studio.", "Perhaps {n} has the charger.", "Meanwhile {n} moved the light.", "Today {n} is second camera.", "I guess {n} shot it.", "Written on the sleeve: {n} The mount is loose.", "People in the frame: {n} Next roll starts at dusk.", "signed on the mat: {n} TWO COPIES EXIST.",
    ),
    "de": ("{n} hielt den Schirm.", "Gestern brachte {n} die Objektive.", "Das Stativ gehört {n}.", "Frau {n} möchte einen größeren Abzug.", "Herr {n} ruft später an.", "Rechnung an {n}, zwei Retuschen.", "Auf der Bank sitzt {n}.", "Das Mädchen im Mantel heißt {n}.", "Aufnahme von {n}, Fensterlicht.", "In der Mitte steht {n}.", "Auf der Hülle: {n} Das Passepartout ist lose."),
    "fr": ("{n} tenait le réflecteur.", "Le trépied appartient à {n}.", "Hier {n} a rapporté les objectifs.", "Madame {n} voudrait un tirage.", "Merci de citer {n}.", "Facture pour {n}, deux retouches.", "Assise sur le banc, {n} sourit.", "Une lettre de {n} est arrivée.", "Portrait de {n}, lumière douce.", "Au dos du cadre : {n} Le verre est fendu."),
    "es": ("{n} sujetaba el reflector.", "El trípode es de {n}.", "Ayer {n} trajo los objetivos.", "La señora {n} quiere una copia.", "Hay que citar a {n}.", "Factura para {n}, dos retoques.", "Sentada en el banco está {n}.", "Llegó una carta de {n}.", "Retrato de {n}, luz suave.", "En el sobre: {n} El marco está suelto."),
}
FORMS = (
    "\nName: {n}\nPhone: {p}\nE-mail: {e}\nID no.: {i}\nAddress: {a}\n", "\nVor- und Nachname | {n}\nTelefon | {p}\nE-Mail | {e}\nAusweis-Nr. | {i}\nAnschrift | {a}\n", "\nNom et prénom = {n}\nTéléphone = {p}\nCourriel = {e}\nPièce n° = {i}\nAdresse = {a}\n",
    "\nNombre\t{n}\nTeléfono\t{p}\nCorreo\t{e}\nDNI\t{i}\nDirección\t{a}\n", "\nKind regards\n{n}\n{a}\nT: {p}\nE: {e}\n", "\nCordialement,\n{n}\n{p}\n", "\nViele Grüße\n{n}\n{e}\n", "\nFrom: {n} <{e}>\n", "\nArtist: {n}\n", "\nClient ... {n}\n",
    "\n \"Creator\": \"{n}\",\n \"Phone\": \"{p}\"\n", "{{\"by\": \"{n}\", \"mail\": \"{e}\"}}", "INFO Owner=\"{n}\" written", "<dc:creator><rdf:Seq><rdf:li>{n}</rdf:li></rdf:Seq></dc:creator>", "\"author\": \"{n}\",", "XMP-dc:Creator : {n}\n", "taken_by='{n}'",
    "\nBest\n{n}\n{f}\n{a}\n{p}\n", "\nRegards,\n{n}\n☎ {p}\n", "\n-- \n{n}\n{f}\nTel. {p}\n{e}\n", "\nAtentamente,\n{n}\n{a}\n{p}", "\nMit besten Grüßen\n{n}\n{a}\nMobil {p}", "\n{n}\n{p}\n✉ {e}\n", "\n-- \n{n}\n{f}, {q}\n", "\nThanks!\n{n}\n{f}\nM {p}\n", "\nBien cordialement\n{n}\n{f}\n{p}",
)
DETAILS = (
    "Write to {e} for the files.", "Mail: {e}.", "Her address is {e}, I think.", "Schreiben Sie an {e}.", "Écrivez à {e}.", "Escriba a {e}.", "[{e}](mailto:{e})", "reach me at {e} or {p}", "Ring {p} at the door.", "Tel. {p}", "Phone {p}.", "Call me on {p} tonight.", "Bitte unter {p} melden.",
    "Appelez le {p} demain.", "Llame al {p} por la mañana.", "mobile: {p}", "ph:{p}", "Passport no. {i} was copied.", "ID card {i} is on file.", "Driving licence {i} seen.", "Ausweisnummer {i} notiert.", "Passeport n° {i} vérifié.", "DNI {i} anotado.", "SSN {i}.", "Sozialversicherungsnummer: {i}",
    "Prints go to {a}.", "Ship to {a}.", "Meet at {a}, second floor.", "She lives at {a}. The key is outside.", "Lieferung an {a}.", "Sie wohnt in der {a}.", "Livrer au {a}.", "Il habite au {a}.", "Enviar a {a}.", "Vive en {a}.", "The parcel for {a} came back.", "Address: {a} Please ring twice.", "Delivery address: {a} The gate is open.", "Anschrift: {a}", "Adresse : {a}", "Dirección: {a}", "Their new flat: {a}",
)
BAD = (
    "\n \"City\": \"{q}\",\n \"Model\": \"{d}\"\n", "\"lab\": \"{f}\",", "Model=\"{d}\" read", "<rdf:li>{q}</rdf:li>", "place='{q}'", "the {d} II and the {d} III",
    "PROPERTY RELEASE / {q}", "CONTACT SHEET {u}", "FINAL SELECTION", "EQUIPMENT LIST, {q}", "DAILY REPORT", "RAW FILES ONLY", "SECOND CARD OF {q}", "PRINT ORDER {u}", "Bildliste Sommer", "Bon de commande", "Hoja de contactos", "Yesterday {g} came along.", "Perhaps Monday works.", "Afterwards Tuesday was free.",
    "The {n} Medal goes to a student.", "We met at the {n} Theatre.", "An evening at the {n} Gallery.", "{n} Studio closed early.", "{n} GmbH sent an offer.", "Die {n}-Stiftung fördert das.", "Die {n} Brücke ist gesperrt.", "Le prix {n} est remis en mai.", "Fundación {n} paga el marco.",
    "La rue {n} est fermée.", "{n} Street is closed.", "The {n} Award was shared.", "Works of the {n} Trust, box 3.", "We drove from {q} to {q}.", "Fog over {q} this morning.", "Three frames near {q} are soft.", "A view from {q}, {q} is missing.", "{q}, {q} and the old pier.", "Der Weg nach {q}, {q} war nass.", "La route de {q} est coupée.", "La luz de {q} era mejor.", "After {q} we stopped.", "near {q}, {q}, at dawn", "We arrived at {q}, {q} late.", "# {q}, {q}\n", "keywords: {q}, {q}, {q}", "Seen from {q}, {q}; the rest is soft.", "{q}, {q} 2019", "A postcard from {q}, {q}.", "the road to {q}, {q} again", "Das Licht von {q}, {q}, war hart.", "Les toits de {q}, {q}, au loin.", "Los tejados de {q}, {q}.", "with {q} behind us", "Photo: {q} at dusk", "by {q}, {q}", "Foto von {q}.", "for {q} and {q}, 12 prints", "The train to {q} was late.", "{q} was empty.", "{q} looked better in colour.",
    "Nebel über {q}.", "Vue de {q} le soir.", "Vista de {q} al amanecer.", "In {q}, {q} and {q} it rained.", "Only {q} stays.", "The {d} needs a firmware update.", "Shot on the {d}.", "Die {d} wurde gereinigt.", "Le {d} chauffe.", "La {d} se cuelga.", "{f} sent the frames.", "Ask {f} for a quote.",
    "{g} smiled at last.", "Thanks to {g} for the tea.", "{g} and {g} took the bus.", "Order no. {u} was cancelled.", "Serial number {u} of the body.", "Frame {u}, exposure index {u}.", "Coordinates {k} are wrong.", "\n \"Position\": \"{k}\",\n", "GPS {k}", "lat/lon {k}", "at {k}, altitude {u} m", "copied {u} bytes in {u} ms", "size={u}", "mtime={u} changed", "IMG_{u}.jpg and P{u}.CR2 are twins",
    "Batch {u}-{u}-{u} of scans.", "taken 2019-04-0{s} 12:3{s}:00", "am 1{s}.04.2018 um 8 Uhr", "hash 9f{u}ab{u}", "logo@2x.png and sprite@3x.webp", "user@host:/srv/photos", "rsync pics@nas:/a /b", "12 pictures of the old Street market", "took 40 minutes down the Road", "{u} files in Lane box {s}", "Invoice {u}/{s} is paid.", "build {u}, version {s}.{s}.{s}", "ISO 6400, 1/{u} s, f/{s}", "lens 24-70 f/2.8 no. {u}",
)
MAIL_HOSTS = ("mail.example", "post.example", "foto.invalid", "studio.test", "web.example.org", "inbox.example.com")


@dataclass(frozen=True)
class Made:
    """A sentence, and the (kind, start, end) of the details in it."""

    text: str
    spans: tuple[tuple[str, int, int], ...]


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def surname(rng: random.Random) -> str:
    name = rng.choice(SUR_STARTS) + rng.choice(("", "", "a", "o", "e")) + rng.choice(SUR_ENDS)
    if rng.random() < 0.12:
        name += "-" + rng.choice(SUR_STARTS) + rng.choice(SUR_ENDS)
    part = rng.choice(SUR_PARTS) if rng.random() < 0.12 else ""
    return part + name


def person(rng: random.Random, given: tuple[str, ...]) -> str:
    first, last = rng.choice(given), surname(rng)
    turn = rng.random()
    if turn < 0.08:
        return f"{last}, {first}"
    if turn < 0.22:
        return f"{first[0]}. {last}"
    if turn < 0.28:
        return f"{first} {rng.choice(given)} {last}"
    if turn < 0.34:
        return f"{first} {rng.choice('ABCDEFGHJKLMNPRST')}. {last}"
    if turn < 0.40:
        return f"{first} {last.upper()}"
    if turn < 0.42:
        return f"{first.upper()} {last.upper()}"
    if turn < 0.44:
        return f"{first.lower()} {last.lower()}"
    return f"{first} {last}"


def email(rng: random.Random) -> str:
    local = rng.choice((surname(rng).lower().replace(" ", "").replace("'", ""), f"{rng.choice('abcdefgjklmnprst')}.{surname(rng).lower().replace(' ', '').replace(chr(39), '')}", f"info-{rng.choice(SUR_STARTS).lower()}{_digits(rng, 2)}", f"{rng.choice(SUR_STARTS).lower()}_{_digits(rng, 3)}"))
    host = rng.choice(MAIL_HOSTS)
    turn = rng.random()
    if turn < 0.7:
        return f"{local}@{host}"
    if turn < 0.85:
        return f"{local} [at] {host.replace('.', ' [dot] ')}"
    return f"{local} AT {host.replace('.', ' DOT ')}"


def phone(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    return rng.choice((f"{rng.randint(201, 989)}.555.01{d(2)}", f"+1-{rng.randint(201, 989)}-555-01{d(2)}", f"1 ({rng.randint(201, 989)}) 555 01{d(2)}", f"+1 {rng.randint(201, 989)} 555 01{d(2)}", f"+61 491 57{d(1)} {d(3)}", f"555 {d(3)} {d(3)}", f"+44 20 7946 0{d(3)}", f"07700 900{d(3)}", f"({rng.randint(201, 989)}) 555-01{d(2)}", f"{rng.randint(201, 989)}-555-01{d(2)}", f"030 23125 {d(3)}", f"+49 30 23125{d(3)}", f"+33 1 99 00 {d(2)} {d(2)}", f"01 99 00 {d(2)} {d(2)}", f"555 {d(2)} {d(2)} {d(2)}", f"+1415555{d(4)}", f"0049 30 23125{d(3)}", f"555-01{d(2)}", f"+34 {rng.choice('679')}{d(2)} {d(3)} {d(3)}", f"+44 (0)7700 900{d(3)}", f"0{d(3)}/{d(6)}", f"+41 44 {d(3)} {d(2)} {d(2)}"))


def id_number(rng: random.Random) -> str:
    d, c = lambda n: _digits(rng, n), lambda n: "".join(rng.choice("ABCDEFGHJKLMNPRSTXYZ") for _ in range(n))
    return rng.choice((f"9{d(2)}-{d(2)}-{d(4)}", f"{c(1)}{d(8)}", f"{c(2)}{d(7)}", f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}", f"{c(1)}{d(2)}{c(1)}{d(2)}{c(1)}{d(2)}", f"{d(8)}-{c(1)}", f"{d(8)}{c(1)}", f"{rng.randint(1, 2)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", d(9), d(12), f"{c(5)}-{d(6)}-{c(2)}{d(1)}{c(2)}", f"{d(2)} {d(6)} {c(1)} {d(3)}", f"X{d(7)}{c(1)}"))


def address(rng: random.Random) -> str:
    n, post, town = rng.randint(1, 2_500), _digits(rng, 5), rng.choice(SUR_STARTS) + rng.choice(("well", "strand", "beck", "court", "mark", "ton", "ville", "stadt", "moor"))
    house = f"{n}{rng.choice(('', '', '', 'A', 'b', '-4'))}"
    street = rng.choice(("Maple", "Quarry", "Saltmarsh", "Pine Hill", "Linden", "Birken", "Moulin"))
    gap = rng.choice((", ", "\n", "; ", " · "))
    found = rng.choice((
        f"{house} {street} {rng.choice(('Street', 'Road', 'Lane', 'Row', 'Close', 'Dr', 'Terrace', 'Avenue'))}{gap}{town}", f"{house} {street} {rng.choice(('Street', 'Road', 'Lane', 'Row', 'Avenue', 'St.', 'Drive', 'Close'))}{gap}{town} QX{rng.randint(1, 19)} {rng.randint(1, 9)}AB", f"{n} {street} {rng.choice(('Rd', 'Ave', 'Blvd', 'St'))}, Apt {rng.randint(1, 60)}{gap}{town}, ZZ {post}", f"{n} {street} {rng.choice(('Street', 'Terrace'))}",
        f"{rng.choice(('Lindenweg', 'Birkenallee', 'Am Hang', 'Hauptstraße', 'Mühlgasse', 'Ringstr.'))} {n % 200 + 1}{rng.choice(('', 'a', ' b'))}{gap}{rng.choice(('', 'D-'))}{post} {town}", f"{n % 200 + 1}{rng.choice(('', ' bis', ' ter'))}, {rng.choice(('rue', 'avenue', 'quai', 'place'))} {rng.choice(('des Moulins', 'de la Gare', 'du Pont', 'Voltine'))}{gap}{post} {town}",
        f"{rng.choice(('Calle', 'Plaza', 'Avenida', 'Paseo'))} {rng.choice(('del Sol', 'de la Luz', 'Mayor', 'Real'))}, {rng.choice(('', 'n.º '))}{n % 200 + 1}{rng.choice(('', ', 2.º B', ', bajo'))}{gap}{post} {town}",
    ))
    return found.lower() if rng.random() < 0.2 else found


def made(rng: random.Random, frame: str, good: bool, given: tuple[str, ...], places: tuple[str, ...] = ()) -> Made:
    """A frame filled with drawn values, with the places of those that are personal details. Half of the decoy places come from `places`."""
    makers = {
        "n": ("name", lambda: person(rng, given)), "e": ("email", lambda: email(rng)), "p": ("phone", lambda: phone(rng)), "i": ("id_number", lambda: id_number(rng)), "a": ("address", lambda: address(rng)),
        "q": (None, lambda: rng.choice(places if places and rng.random() < 0.5 else PLACES)), "d": (None, lambda: rng.choice(DEVICES)), "f": (None, lambda: f"{rng.choice(FIRM_WORDS)} {rng.choice(places or PLACES)}" if rng.random() < 0.6 else rng.choice(FIRMS)), "g": (None, lambda: rng.choice(given)), "u": (None, lambda: str(rng.randint(100, 10 ** rng.randint(4, 10)))), "s": (None, lambda: str(rng.randint(1, 9))), "k": (None, lambda: f"{rng.uniform(-90, 90):.5f}{rng.choice((' ', ', '))}{rng.uniform(-180, 180):.5f}"),
    }
    out, spans, at = "", [], 0
    while (cut := frame.find("{", at)) >= 0:
        out += frame[at:cut]
        if frame[cut + 1] == "{":  # a brace itself
            out, at = out + "{", cut + 2
            continue
        kind, make = makers[frame[cut + 1]]
        value = make()
        if good and kind:
            spans.append((kind, len(out), len(out) + len(value)))
        out += value
        at = cut + 3
    out += frame[at:].replace("}}", "}")
    return Made(out.upper() if not good and rng.random() < 0.08 else out, tuple(spans))


def frames() -> list[tuple[str, bool]]:
    """All frames, and whether what they hold are personal details."""
    good = [f for fs in GOOD.values() for f in fs]
    return [*((f, True) for f in good), *((f, True) for f in FORMS), *((f, True) for f in DETAILS), *((f, False) for f in BAD)]
