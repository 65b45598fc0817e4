"""The small labelled table that the personal-information model is trained from.

Sentences of everyday letters, notes and logs were written and labelled for this table as frames: a slot in capitals is a
place of a kind, a slot in small letters is text that looks like one and is none. Slots are filled from lists of common names
and from made-up words. Every fifth frame and entry of a list can be held out, so that a model can be measured on sentences,
names, streets and towns that it has never seen.
"""

from __future__ import annotations

import random
import re

# Frames: {N} full name, {G} given name alone, {E} email, {P} phone, {I} identity number with its words before it, {J} identity
# number alone, {A} street address, {H} one in German, {F} in French, {S} in Spanish; {b} business, {s} street without number,
# {g} German street without number, {c} town, {n} number, {d} date, {t} ticket, {p} parcel, {v} version, {o} object, {u} uuid,
# {z} postcode, {x} decimal, {r} long number of an order or account, {w} word with a capital, {k} nickname.
FRAMES = """
Dear {G},
Hello {N},
Good morning {G} and {G},
Hey {G}! Any news from the printer?
Thanks, {G}
Best wishes, {N}
Yours sincerely, {N}
All the best, {G}
Sent by {N}
{N}
{N}
{N}
{G}
{E}
{P}
{A}
From: {N} <{E}>
To: {N}
Cc: {E}; {E}
On Tuesday {N} wrote:
— {N} wrote:
— {G} wrote:
Dr. {N} moved the appointment to {d}.
Mr. {N} and Mrs. {N} want a refund from {b}.
Ms. {N} lost her umbrella in {s}.
Prof. {N} will open the exhibition in {c}.
We spoke to Dr. {N} at {b} yesterday.
I think {G} has the spare key.
Please tell {G} that the boiler is fixed.
Could {G} bring the ladder tomorrow?
My cousin {G} drove over with the trailer.
{G} fixed the fence, {G} painted it.
{G} says the parcel never came.
{G}'s bicycle is still in the cellar.
{N}'s garage blocks the footpath.
{N} drove over and took the measurements.
{N} has not paid invoice {t} yet.
{N} complained about the noise from {b}.
{N} ({E}) runs the tennis club.
{N}: "nobody told me about the meeting"
Ask for {N} at the front desk of {b}.
ask for {N}, the caretaker
We forgot to thank {N} for the cake.
According to {N}, the lift on {s} is out of order.
Photo: {N} (left) with {G} and {G}.
Team: {N}, {N} and {N}.
Witnesses: {N}; {N}.
Guests were {N} and {N} from {c}.
Patient {N}, born {d}, needs new glasses.
Tenant: {N}, flat {n}
Passenger {N} missed flight {w} {n}.
Driver {N} stopped at {b} for fuel.
Customer: {N}
Name: {N}
name = {N}
[Name] {N}
full_name="{N}"
contact={N}; phone={P}
{N};{P};{E}
{n}, {N}, {A}, {c}
{N} lives at {A}.
{N} used to live at {A} until {d}.
Resident of {A}: {N}
The family at {A} has two dogs.
Her flat is {A}, third floor.
He gave his home as {A} but sleeps in {c}.
Send the flowers to {N}, {A}.
Deliver to {A} before noon.
Pick-up at {A}, drop-off at {A}.
They moved from {A} to {A} in spring.
Is {A} the green house?
The plumber waits in front of {A}.
Invoice address: {A}
Address: {A}
address = {A}
[Address] {A}
[Address] {H}
[Address] {S}
address={F}
Home address {A}; office at {s}.
user_address: {A} | user_city: {c}
search text "{A}" gave no hit in {c}
Lookup of {A} and {A} took {n} ms.
You can reach me at {P}.
My mobile is {P}, call any time after six.
My cell is {P}
call me back on {P}
Ring {G} on {P} first.
Dial {P} and ask for extension {n}.
Phone: {P}
phone = {P}
[Phone] {P}
Tel. {P}, fax {P}
tel={P}; mail={E}
New number: {P}, the old one was {P}.
WhatsApp {P} or write to {E}
Nobody picks up at {P}; I told {G}.
Emergency contact ({P}): {N}
We checked by phone ({P}) with {N}.
Write to {E} before {d}.
Mail: {E}
Email: {E}
[E-mail] {E}
e-mail = {E}
Please forward it to {E} and {E}.
mailto:{E}
My address is {E}, hers is {E}.
The newsletter to {E} came back.
The sender {E} signs as {G}.
Login {E} was locked after three attempts.
He showed {I} at the counter.
He showed {J} at the counter.
The form contains {I} in plain sight.
The form contains {J} in plain sight.
She read out {I} over the phone, delete the recording.
She read out {J} over the phone, delete the recording.
Copy of {I} attached, issued to {N}.
{N}, {I}, checked in on {d}.
{N}, {I}, owner of lot {p}
applicant {N}, {J}
id = {J}
ID: {J}
[ID] {J}
Please shred the scan with {I}.
Please shred the scan with {J}.
Background check: {I}, {A}, {P}
Hallo {G}, der Termin passt mir gut.
Lieber {G}, danke für die Blumen.
Sehr geehrte Frau {N},
Sehr geehrter Herr {N},
Mit besten Grüßen, {N}
Herr {N} wohnt {H}.
Frau {N} ist von der {H} nach {c} gezogen.
{N} hat das Paket an {H} nicht bekommen.
Die Wohnung {H} steht leer.
Rückruf bitte unter {P} oder an {E}.
Auf dem Blatt steht {I}, das muss weg.
Auf dem Blatt steht {J}, das muss weg.
Cher {G}, merci pour ta lettre.
Chère Madame {N},
Bien cordialement, {N}
M. {N} habite {F}.
Mme {N} a changé d’adresse : {F}.
La livraison au {F} est prévue pour {d}.
Appelez-moi au {P} ou écrivez à {E}.
On lit {I} sur la photocopie.
On lit {J} sur la photocopie.
Querido {G}, gracias por la foto.
Estimada señora {N},
Atentamente, {N}
El señor {N} vive en {S}.
La señora {N} se mudó a {S}.
Entrega en {S}, segundo piso.
Mi número es {P} y mi correo {E}.
En la copia se lee {I}.
En la copia se lee {J}.
Cześć {G}, dziękuję za zdjęcia.
Z poważaniem, {N}
Pani {N} mieszka w {c}, tel. {P}.
Pan {N} ma nowy adres {E}.
Na kopii widać {I}.
Na kopii widać {J}.
{G}さん、ありがとうございます。
{N}様の電話番号は{P}です。
お届け先は{A}です。
メールは{E}へ。
書類に{I}と書いてあります。
Cara {G}, ci vediamo a {c}.
Beste {G}, de sleutel ligt bij {b}.
Kære {N}, tak for i går.
{b} opens at nine and closes at five.
{b} is cheaper than {b}.
Lunch at {b} on {s}?
The new owner of {b} repainted the front.
{b} next to {b} has no ramp.
We ordered chairs from {b} in {c}.
Is {b} on {s} still there?
{b} hat montags zu.
{b} ist an der {g} zu finden.
{b} est fermé le lundi.
{b} ne répond plus depuis {d}.
{b} cierra los lunes.
{b} jest zamknięte w poniedziałki.
{b}は月曜日が休みです。
{b} won the award twice.
The roof of {b} leaks.
{s} is closed for works until {d}.
They resurfaced {s} and {s} last week.
Traffic on {s} near {c} is heavy.
A tree fell across {s}.
The house number on {s} can't be read.
Die {g} ist gesperrt.
La obra en {s} termina el {d}.
{c} and {c} share one fire brigade.
The bus from {c} to {c} runs every {n} minutes.
{c} has {n} inhabitants.
Greetings from {c}!
The mayor of {c} opened the {w} Bridge.
{w} Valley and {w} Lake are popular in summer.
The {w} River floods every spring.
{w} County pays for the {w} Library.
{w} Airlines cancelled flight {n}.
The {w} Award goes to {b}.
{w} is the working title, {w} the final one.
Order {r} was shipped on {d}.
Order no. {r} and invoice {t} are paid.
Account {r} shows a balance of {x}.
Reference {r}, please quote it.
Tracking number {r}
Case {t} was merged into {t}.
See {t} and parcel {p}.
Lot {p} was sold for {n} in {d}.
Plot {p} borders on plot {p}.
Object {o} has {n} vertices.
Nodes {o} and {o} are too close.
Key {u} is unknown.
Release {v} is faster than {v}.
The file is {n} MB, checksum {u}.
Point {x}, {x} lies in the sea.
Bounds {x} {x} {x} {x}
Temperature {x} at {n} metres
Meeting on {d} at 10:30, room {n}.
Page {n} of {n}
Row {n} of {n} has no value, see {t}.
Postcode {z} belongs to {c}.
The zip {z} is missing in {n} rows.
Speed went up from {n} to {n} rows per second.
Version {v} was built on {d} at 04:12.
Query took {n} ms, {n} rows.
SELECT name FROM stops WHERE id = {n} AND score > {x};
Visit https://www.{k}.example/page?id={n} for details.
Phone: none
Name: -
[E-mail] none
Address: unknown
id = none
No name, no phone, no mail was given.
Please call the office and mail the form to the county.
The driver's licence and the passport must be shown.
May was wet, June was dry, August was hot.
Rose bushes and ivy grow well here; hope it lasts.
Mark the box, sign the form and bill the office.
Grace period ends soon; faith in the process is low.
Will the summer fair be in the park? Frank answers are welcome.
Art and music classes start in September.
Dean and chapter agreed; the pastor and the dean signed nothing.
Drew a map, then miles of road, then a heath.
Norm values differ; bill and pat are verbs too.
Monday to Friday, Easter and Christmas excepted.
English, French and Polish versions exist.
North of the River Road the map is empty.
Street View and Open Data help a lot.
Google Maps and Open Street Map disagree.
The Summer Market and the Winter Garden were full.
First Street is shorter than Fifth Avenue.
The Street Names Committee met in the Town Hall.
Zustand gut, Maße falsch, Länge {x} m.
Die Datei hat {n} Zeilen, Stand {d}.
Zeile {n} fehlt, Spalte {n} ist leer.
Die Nummer {t} gehört zum Grundstück {p}.
Le fichier contient {n} lignes et {n} erreurs.
La ligne {n} manque, voir {t}.
Le terrain {p} appartient à la commune de {c}.
El archivo tiene {n} filas y {n} errores.
Falta la fila {n}, véase {t}.
El terreno {p} es de {c}.
Plik ma {n} wierszy, stan na {d}.
Brakuje wiersza {n}, zob. {t}.
ファイルには{n}行あります。
{d}に{c}で更新されました。
{b}は{s}沿いにあります。
{s}は工事中です。
{o}は{d}に{s}へ移されました。
会議は{d}、{b}の隣で{n}時からです。
{N}さんは{A}に住んでいます。
住所：{A}、電話：{P}
{P}に電話してください。
{E}まで連絡をください。
{J}という番号を見ました。
番号{r}は注文番号です。
Object {o} wurde am {d} gelöscht.
L’objet {o} a été supprimé le {d}.
El objeto {o} se borró el {d}.
""".strip().split("\n")
# Words that sentences are made of beside the frames: who does something, what is done to somebody, and plain sentences.
DOINGS = (
    "called about the roof|sent the plan back|came by on foot|waited an hour|will bring the keys|found the mistake|has moved away|wants a receipt|asked for more time|signed the lease|left early|measured the yard|never answered|owns the field|agreed at once|"
    "wrote a long letter|checked the list twice|was here this morning|drew the border|knows the way|repaired the gate|forgot the date|counted the steps|needs a permit|sold the barn|took over in spring|paid in cash|lost the map|painted the door|talked to the neighbours|"
    "votes against it|runs the bakery|teaches at the school|reads the meter|confirmed the size|walked along the river|broke the lock|keeps bees|saw the sign|rents two rooms|corrected the entry|added the missing steps|rejected the change|closed the account|reported the leak|"
    "denies it|is on holiday|is away until noon|does not agree|did the survey|can explain it|should know|might be late|has the old photos|had the wrong form|was right about the slope"
).split("|")
DONE_TO = (
    "We met|I asked|They thanked|You should call|Please contact|I just saw|Nobody told|We invited|She married|He knows|The office informed|The police questioned|I wrote to|We waited for|Talk to|It belongs to|A letter from|The dog of|A gift for|The garden of|"
    "Signed by|Prepared by|Drawn by|Checked with|Sold to|In memory of|On behalf of|Together with|Photo by|Message for|Reply from|Notes of|Approved by|Paid by|Addressed to|The keys are with|The report by|This was done by|as told by|sent to|seen by|c/o|"
    "Geschickt von|Bestellt von|Unterschrieben von|Geprüft von|Erfasst von|Bezahlt von|Ein Brief von|Grüße von|Das Haus von|Wir trafen|Ich fragte|Bitte an|Envoyé par|Signé par|Payé par|Vérifié par|La maison de|Un mot de|J’ai vu|Nous avons vu|"
    "Enviado por|Firmado por|Pagado por|Revisado por|La casa de|Una carta de|Vi a|Hablé con|Wysłane przez|Podpisane przez|Dom|List od|Widziałem|Rozmawiałem z|Met|Saw|Sued by|Owned by|Rented to|Left with|Bought from|Filed by|Seen with|Cousin of|Thanks to|Love from"
).split("|")
HAILS = "Hi|Hello|Hey|Dear|Hallo|Liebe|Guten Tag|Bonjour|Salut|Cher|Hola|Buenos días|Querida|Cześć|Dzień dobry|Ciao|Hej|Thanks|Thank you|Danke|Merci|Gracias|Regards|Kind regards|Cheers|Mit freundlichem Gruß|Viele Grüße|Cordialement|Saludos|Pozdrawiam|Sorry|Yes|No|Well|Also|First|Then|Later|Today|Yesterday|However|In May|In the end|For now|Reported by|Ask|Ping|Call|Tell|Ring|Resident|Owner|Neighbour|Frau|Herr|Madame|Monsieur|Señor|Señora|Pani|Pan|Mrs.|Mr.|Ms.|Dr.|Prof.|Gesehen von|Gezeichnet|Vu par|Visto por|Napisał|Według".split("|")
NOUNS = "bridge gate list roof sign field path wall border layer tile map file index score label point shape column value import export upload backup update server window garden school office market station hospital train bus ticket letter invoice meeting room floor door lamp table chair engine filter cable printer camera river forest hill lake beach island harbour tower church museum library weather storm winter summer week month year plan budget contract survey count total average query result error warning version release note comment review change request answer question rule limit range distance area volume length width height".split()
QUALITIES = "old new late early long short wrong right empty full open closed broken missing small large cold warm clean dirty free busy quiet ready final rough exact double public private local remote slow fast cheap stable heavy dark bright narrow wide flat steep round plain odd".split()
ACTS = "shows hides needs covers follows replaces breaks joins splits crosses misses carries limits changes keeps holds moves loads writes reads sorts drops merges closes opens blocks delays repeats confuses explains helps".split()
PLAIN = (
    "The {1} of the {1} is {2}.|A {2} {1} {3} the {1}.|This {1} {3} every {1} twice.|No {1} was {2} before the {1}.|{4} and {1} were {2}, the {1} was not.|After the {1} the {1} stayed {2}.|Each {1} {3} one {1} only.|If the {1} is {2}, the {1} {3} it.|{4} of the {1} is {x}, {4} of the {1} {x}.|"
    "Thanks, the {1} {3} it now.|The {2} {1} took {n} days.|{4} {n} and {1} {n} are {2}.|Why is the {1} so {2}?|{5} {4} {3} the {1}.|{4}s with a {2} {1} fail.|Mo-Fr 09:00-17:30, {4} {2}.|{4}: {2}, {1}: {n}|The {w} {4} is a {2} {1}, not a {1}.|Only {n} of {n} {1}s were {2}; see {t}.|"
    "{h}, {15} {3} the {1}.|{h}, {15} {3} it {n} times.|{4}, {15} {3} the {1}, {15} {3} a {1}.|{15} {3} {15}, see {t}.|{h} {15} {3} the {1}.|{7} {16} den {7}.|{6} {7} {16} den {7}, daher {16} der {7} die {7}.|{w} {v} {16} den {7} von {7}.|{16} {6} {7} den {7}?|Bitte {7} {16}, {8}.|{4} {v} {16} die {7}.|"
    "La {9} de la {9} et le {9} du {9}.|El {11} de la {11} y la {11} del {11}.|{13} od {13} do {13}, {14}.|{h}, {6} {7} {16}.|{h}, le {9} de la {9}.|{h}, la {11} de {11}.|"
    "{6} {7} ist {8}.|{6} {7} hat {n} {7}, aber keine {7}.|{7} und {7} waren {8}, daher fehlt {6} {7}.|{7}: {n}, {7}: {x}|Le {9} est trop {10}.|La {9} de {c} n’a pas de {9}.|Les {9}s étaient {10}s hier.|El {11} está {12}.|La {11} no tiene {11}.|{11} y {11} estaban {12}s: {x}, {x}.|{13} jest {14}.|{13} i {13} są {14}."
).split("|")
WORDS = {
    "h": HAILS, "15": "that this it which what you we they he she I one all none both".split(), "16": "ändert zeigt verdeckt braucht teilt kreuzt ersetzt bricht hält bewegt lädt schreibt liest sortiert schließt öffnet verzögert trennt".split(),
    "1": NOUNS, "2": QUALITIES, "3": ACTS, "4": [w.capitalize() for w in NOUNS], "5": [w.capitalize() for w in QUALITIES], "6": "Der Die Das Eine Ein Jede Diese Unsere".split(),
    "7": "Brücke Liste Karte Datei Grenze Zeile Spalte Tür Straße Wand Dach Schule Post Kirche Halle Nummer Farbe Größe Breite Höhe Messung Prüfung Änderung Frage Antwort Woche Stunde Ecke Seite Stelle Wohnung Rechnung Lieferung Ausgabe Fassung".split(), "8": "alt neu leer falsch richtig spät offen zu kaputt verschoben vertauscht geprüft gelöscht doppelt gesperrt fertig".split(),
    "9": "pont liste carte fichier limite ligne colonne porte mur toit route école gare poste halle table mesure réponse question semaine lettre facture page couche tuile".split(), "10": "grand petit long court vide large lourd froid rapide ancien étroit".split(),
    "11": "Puente lista mapa archivo límite fila columna puerta muro techo calle escuela estación correo mesa medida respuesta pregunta semana carta factura página capa longitud latitud tesela".split(), "12": "vacío largo corto viejo nuevo abierto cerrado roto doblado al revés perdido movido".replace("al revés", "torcido").split(),
    "13": "Most lista mapa plik granica wiersz kolumna drzwi ściana dach ulica szkoła dworzec poczta stół pomiar odpowiedź pytanie tydzień list faktura strona warstwa".split(), "14": "stary nowy pusty długi krótki otwarty zamknięty zepsuty podwójny przesunięty".split(),
}
KIND_OF = {"N": "person_name", "G": "person_name", "E": "email", "P": "phone", "I": "id_number", "J": "id_number", "A": "street_address", "H": "street_address", "F": "street_address", "S": "street_address"}

# Common given names, family names, street names and towns of many countries.
GIVEN = (
    "Maria James Fatima Chen Olivia Ahmed Sofia Liam Priya Mateo Ingrid Kofi Hannah Dmitri Aisha Lucas Yuki Amara Pedro Emily Ravi Chloe Omar Freya Diego Leila Noah Mei Thomas Zainab Erik Carla Samuel Nina Giovanni Ruth "
    "Hassan Astrid Paul Camila George Anna Tariq Elise Victor Salma Henry Ida Marco Jane Ivan Lena Carlos Ewa Peter Rania Simon Clara Jorge Helga Daniel Beatriz Martin Sunita Andrew Paola Karl Naomi Luis Agnes Robert Yasmin "
    "Stefan Laura Kenji Alice Pablo Marta Philip Rosa Jonas Irene Adam Sara Michael Julia William Esther David Elena Richard Monika Charles Teresa Edward Katrin Jürgen Zoë André Łukasz José Inés Søren Åsa Renée Björn"
).split()
FAMILY = (
    "Gonzalez Smith Klopp Nakamura Okafor Ivanov Rossi Kowalski Nguyen Hansen Silva Khan Dubois Novak Johnson Mbeki Andersson Patel Costa Brown Schneider Tanaka Ferrari Cohen Larsen Moreau Wilson Haddad Petrov Santos Clark Weber "
    "Yilmaz Lindgren Garcia Walker Fischer Mensah Romano Lewis Zhang Bernard Nowak Harris Virtanen Lopez Baker Keller Suzuki Marino Young Farouk Jansen Torres King Hoffmann Banerjee Laurent Wright Popescu Ramirez Scott Wagner "
    "Diallo Esposito Green Horvath Castillo Adams Becker Ito Girard Nelson Eriksen Morales Carter Lang Sharma Fontaine Mitchell Kovács Müller Peña García Łapiński Sørensen Åberg Lefèvre Çelik Dvořák"
).split()
STREETS = (
    "Oak Maple Washington Lincoln Cedar Elm Church Mill Park High Victoria King Queen Station Walnut Chestnut Spring Franklin Jackson River Sunset Pine Hill Lake Madison Jefferson Highland Dogwood Hickory Magnolia Cherry Willow "
    "Meadow Forest Ridge Bridge Garden Market Academy College Liberty Union Prospect Center Main Broad Canal Harbour Orchard Baker Abbey Castle Windsor Grove Rosewood Sycamore Poplar Birch Juniper Laurel Aspen Hawthorn Linden"
).split()
TOWNS = (
    "Springfield Greenville Bristol Salem Fairview Oxford Leeds Dayton Bergen Utrecht Lyon Girona Krakow Lisbon Verona Graz Aarhus Turku Plzen Cork Dundee Halifax Boulder Fresno Tucson Omaha Reno Savannah Mobile Tampa Nantes Lille Toledo "
    "Bilbao Gdansk Bremen Kassel Ulm Bath York Derby Luton Perth Hobart Dunedin Napier Kyoto Nara Sapporo Puebla Quito Cusco Natal Recife"
).split()
TOWN_ENDS = "burg dale field ford haven mont port ridge ton ville wick ham bridge stadt".split()
TRADES = (
    "Bakery|Bank|Books|Cafe|Car Wash|Catering|Cinema|Cleaners|Clothing|College|Construction|Daycare|Deli|Dental Care|Dental Clinic|Diner|Electronics|Elementary School|Eye Care|Farm|Fitness|Flowers|Fire Station|Furniture|Garage|"
    "Garden Center|Grill|Gym|Hair Salon|Hardware|Heating|Hospital|Hotel|Insurance|Jewelers|Kitchen|Laundry|Law Firm|Law Offices|Library|Logistics|Market|Medical Group|Motors|Museum|Nail Studio|Optics|Paints|Pet Shop|Pharmacy|"
    "Pizza|Plumbing|Pub|Real Estate|Repair|Restaurant|Roofing|School|Shoes|Spa|Sports|Storage|Supply|Tavern|Taxi|Tire Service|Tours|Toys|Travel|University|Veterinary Clinic|Winery|Auto Repair|Credit Union|Community Center|Public Library"
).split("|")
FOREIGN_TRADES = "Café Château Bistró Pâtisserie Boulangerie Crème Señora Phở Taquería Panadería Bäckerei Gasthof Konditorei Trattoria Osteria Pizzeria Bar Hôtel Librería Farmacia Apotheke Brauhaus Restaurace Kawiarnia Sklep São Müller".split()
TYPES = "St Street Str Ave AVE Avenue Av Rd Road Dr Drive Drv Ln Lane La Blvd Boulevard Boul Ct Court Crt Pl Place Way Wy Pkwy Parkway Pky Ter Terrace Trail Sq Square Cir Circle Hwy".split()
ORDINALS = "First Second Third Fourth Fifth Sixth Seventh Tenth 1st 2nd 3rd 5th 8th 12th 21st 33rd 42nd".split()
FEATURES = "Mill Hill Creek Park Bend Lake Ridge Spring Run View Point Grove".split()
DOMAINS = "example.com example.org example.net mail.example shop.example.com post.test school.test office.example.org the-bank.example intra.city.example".split()
LETTERS = "ABCDEFGHJKLMNPQRSTVWXYZ"
WIDE = str.maketrans({c: chr(ord(c) + 0xFEE0) for c in LETTERS})

#: Sounds of made-up words, so that words never seen before are names, streets, businesses and towns alike.
ONSETS = "b br c ch cl d dr f fl g gl gr h j k kl kr l m n p pl pr qu r s sch sk sl sp st t tr v w x y z".split()
VOWELS = "a e i o u a e i o u ai au ee ie oo ou y".split()
CODAS = ["", "", "", "b", "ck", "d", "l", "ll", "m", "n", "nd", "nt", "r", "rd", "rk", "rn", "s", "ss", "st", "t", "tt", "x", "z"]
NAME_ENDS = ["", "", "", "a", "er", "en", "i", "ini", "ski", "sen", "son", "ova", "ov", "ez", "es", "mann", "stein", "berg", "elli", "aux", "eau", "u", "uk", "ian", "ides", "oğlu", "wick", "moor", "ari", "us"]


def _part(items: list[str], held: bool | None) -> list[str]:
    return items if held is None else [x for i, x in enumerate(items) if (i % 5 == 2) == held]


class _Filler:
    def __init__(self, given: list[str], rng: random.Random, held: bool | None) -> None:
        self.r = rng
        part = lambda items: _part(items, held)
        self.given = part(given)
        self.words = {slot: part(items) for slot, items in WORDS.items()}
        self.plain_frames = part(PLAIN)
        self.lists = {name: part(items) for name, items in (("doings", DOINGS), ("done to", DONE_TO), ("hails", HAILS), ("given", GIVEN), ("family", FAMILY), ("street", STREETS), ("town", TOWNS), ("trade", TRADES), ("foreign", FOREIGN_TRADES))}

    def pick(self, items):
        return items[int(self.r.random() * len(items))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def below(self, n: int) -> int:
        return int(self.r.random() * n)

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def made_up(self, most: int = 3) -> str:
        syllables = "".join(self.pick(ONSETS) + self.pick(VOWELS) + self.pick(CODAS) for _ in range(1 + self.below(most)))
        return (syllables if len(syllables) > 3 else syllables + self.pick(["la", "ro", "min", "den"])).capitalize()

    def one_given(self) -> str:
        kind = self.r.random()
        return self.pick(self.given).capitalize() if self.given and kind < 0.35 else self.pick(self.lists["given"]) if kind < 0.8 else self.made_up(2)

    def given_name(self) -> str:
        return self.one_given() + (f"-{self.one_given()}" if self.chance(0.1) else "")

    def one_family(self) -> str:
        return self.pick(self.lists["family"]) if self.chance(0.4) else self.made_up(2) + self.pick(NAME_ENDS)

    def surname(self) -> str:
        name, kind = self.one_family(), self.r.random()
        if kind < 0.06:
            name = self.pick(["O'", "O’", "D'"]) + name
        elif kind < 0.12:
            name = self.pick(["Mc", "Mac"]) + name
        elif kind < 0.2:
            name = self.pick(["van der ", "van ", "von ", "den ", "ter "]) + name
        elif kind < 0.27:
            name = self.pick(["de la ", "dé lá ", "del ", "de ", "da ", "di "]) + name
        elif kind < 0.33:
            name = self.pick(["al-", "el-", "Ben-", "al "]) + name
        if self.chance(0.1):
            name += "-" + self.one_family()
        if self.chance(0.05):
            name = name.translate(str.maketrans("aeo", self.pick(["áéó", "àèö", "âêô"])))
        return name

    def G(self) -> str:
        g = self.given_name()
        return g.upper() if self.chance(0.05) else g.lower() if self.chance(0.02) else g

    def N(self) -> str:
        g, s, kind = self.given_name(), self.surname(), self.r.random()
        if kind < 0.11:
            name = f"{g[0]}. {s}"
        elif kind < 0.21:
            name = f"{g} {self.pick(LETTERS)}. {s}"
        elif kind < 0.31:
            name = f"{s}, {g}"
        else:
            name = f"{g}{'  ' if self.chance(0.05) else ' '}{s}"
        kind = self.r.random()
        return name.upper() if kind < 0.08 else name.lower() if kind < 0.13 else name

    def E(self) -> str:
        ascii_only = lambda name: re.sub(r"[^a-z\-]", "", name.lower()) or "me"
        g, s = ascii_only(self.given_name()), ascii_only(self.surname())
        local = self.pick([f"{g}.{s}", f"{g[0]}{s}", f"{g}{1940 + self.below(70)}", f"{s}_{g[0]}{self.digits(2)}", f"{g}+{self.pick(['news', 'shop', 'work', 'maps'])}", f"{s}-{g}", self.pick(["info", "office", "sales"])])
        domain = self.pick(DOMAINS) if self.chance(0.6) else self.made_up(2).lower() + self.pick([".com", ".org", ".de", ".co.uk", ".test", ".invalid"])
        kind = self.r.random()
        if kind < 0.08:
            mail = f"{local} @ {domain}"
        elif kind < 0.16:
            mail = f"{local} [at] {domain.replace('.', ' [dot] ')}"
        elif kind < 0.22:
            mail = f"{local} at {domain.replace('.', ' dot ')}"
        elif kind < 0.3:
            mail = f"{local}{self.pick(['(at)', ' (at) ', '[at]'])}{domain}"
        else:
            mail = f"{local}@{domain}"
        return mail.upper() if self.chance(0.1) else mail

    def phone(self) -> str:
        a, b, c = self.pick("23456789") + self.digits(2), self.pick("23456789") + self.digits(2), self.digits(4)
        d = self.digits
        p = self.pick([
            f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b}{c}", f"{a}{b}{c}", f"{b}-{c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+1{a}{b}{c}", f"1 ({a}) {b} {c}", f"{a}‑{b}‑{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}",
            f"0{d(2)} {d(4)} {d(4)}", f"+44 {d(2)} {d(4)} {d(4)}", f"+44 (0){d(4)} {d(3)} {d(3)}", f"0{d(4)} {d(6)}", f"(0{d(2)}) {d(5)}-{d(3)}", f"0{d(2)} {d(5)} {d(3)}", f"+49 {d(2)} {d(8)}", f"0049 {d(2)} {d(7)}",
            f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33{d(3)} {d(6)}", f"(0{d(1)}) {d(4)} {d(4)}", f"+61 {d(1)} {d(4)} {d(4)}", f"+48 {d(3)} {d(3)} {d(3)}",
        ])
        return p.translate(str.maketrans("0123456789+()", "０１２３４５６７８９+()")) if self.chance(0.04) else p

    def id_alone(self) -> str:
        d, L = self.digits, LETTERS
        ssn = f"{d(3)}-{d(2)}-{d(4)}"
        return self.pick([ssn, ssn, ssn, ssn.replace("-", " "), ssn.replace("-", ""), f"{self.pick(L)}{d(3)}-{d(4)}-{d(4)}", f"{self.pick(L)}{d(7)}", f"{self.pick(L)}{d(8)}", f"{self.pick(L)}{self.pick(L)}{d(7)}", f"{d(6)}/{d(4)}", f"{d(8)}-{self.pick(L)}", f"{d(2)}.{d(3)}.{d(3)}-{self.pick(L)}", f"{d(4)} {d(4)} {d(4)}"])

    def id_words(self) -> str:
        return self.pick(["SSN ", "SSN: ", "ssn ", "social security number ", "social security no. ", "tax id ", "tax number ", "passport ", "passport no. ", "Passport # ", "travel document ", "licence no. ", "driver's licence ", "driver’s license ", "DL# ", "DL ", "national id ", "ID card ", "personal number ", "citizen no. ", "identity card "])

    def street_word(self) -> str:
        return self.pick(self.lists["street"]) if self.chance(0.5) else self.made_up()

    def street(self) -> str:
        name = self.pick(ORDINALS) if self.chance(0.12) else self.street_word() + (" " + self.pick(FEATURES) if self.chance(0.3) else "")
        return f"{name} {self.pick(TYPES)}"

    def A(self) -> str:
        number = str(1 + self.below(self.pick([99, 999, 9999]))) + self.pick(["", "", "", "", "", "B", " 1/2"])
        direction = self.pick(["", "", "", "", "N ", "S ", "E ", "W ", "N. ", "S. ", "East ", "West ", "North ", "South ", "NW ", "SE "])
        unit = self.pick(["", "", "", "", f", Apt. {self.below(20)}{self.pick('ABC')}", f" Apt {self.below(90)}", f", Unit {self.pick('ABCD')}", f" #{self.below(300)}", f" Ste {self.below(400)}", f", Suite {self.below(90)}", f" Unit {self.below(30)}"])
        a = f"{number} {direction}{self.street()}{unit}"
        kind = self.r.random()
        return a.upper() if kind < 0.08 else a.lower() if kind < 0.11 else a

    def german_street(self) -> str:
        return f"{self.pick(['Am ', 'Am ', ''])}{self.street_word()}platz" if self.chance(0.2) else self.street_word() + self.pick(["straße", "str.", "weg", "straße", "strasse", "gasse", "allee"])

    def H(self) -> str:
        return f"{self.german_street()} {1 + self.below(200)}{self.pick(['', '', '', 'a', 'b', 'c'])}"

    def F(self) -> str:
        return f"{1 + self.below(120)}{self.pick(['', '', ' bis', ' ter'])}{self.pick([',', ',', ''])} {self.pick(['rue', 'avenue', 'boulevard', 'place', 'chemin', 'quai'])} {self.pick(['', '', 'du ', 'de ', 'des '])}{self.street_word()}"

    def S(self) -> str:
        w = self.street_word()
        return self.pick([f"Calle {w} ", f"Calle {w}, ", f"C/ {w}, ", f"Avenida de {w} n.º ", f"Plaza {w} ", f"Avenida {w} ", f"Paseo del {w} "]) + str(1 + self.below(150))

    def business(self) -> str:
        kind, trade = self.r.random(), self.pick(self.lists["trade"])
        stem = lambda: self.made_up() if self.chance(0.7) else self.pick(self.lists["family"])
        if kind < 0.4:
            name = f"{stem()} {trade}"
        elif kind < 0.52:
            name = f"{stem()} {self.pick(['and', '&'])} {stem()} {trade}"
        elif kind < 0.62:
            name = f"{stem()} {stem()} {trade}"
        elif kind < 0.7:
            name = f"{stem()} {self.pick(['II', 'III', 'No. 2'])} {trade}"
        elif kind < 0.78:
            name = f"{stem()}{self.pick(['’s', chr(39) + 's'])} {trade}"
        elif kind < 0.94:
            name = f"{self.pick(self.lists['foreign'])} {stem()}" + (f" {stem()}" if self.chance(0.5) else "") + (f" {trade}" if self.chance(0.3) else "")
        else:
            name = f"{self.pick(['The ', ''])}{self.pick(['Golden', 'Blue', 'Old', 'New', 'Royal', 'Happy', 'Green'])} {self.pick(['Lion', 'Horse', 'Garden', 'House', 'Fox', 'Star'])} {trade}"
        name += self.pick(["", "", "", "", " Inc", " LLC", " Co.", " & Sons", " GmbH"])
        return name.upper() if self.chance(0.06) else name.lower() if self.chance(0.03) else name

    def town(self) -> str:
        return self.pick(self.lists["town"]) if self.chance(0.4) else self.made_up(2) + self.pick(TOWN_ENDS)

    def made_sentence(self) -> str:
        """A frame put together from the words: somebody does something, something is done to somebody, or nobody is named."""
        kind = self.r.random()
        doing, done_to = self.pick(self.lists["doings"]), self.pick(self.lists["done to"])
        if kind < 0.18:
            return f"{self.pick(['{N}', '{N}', '{G}', '{b}', '{b}', 'The {1} {4}'])} {doing}{self.pick(['.', '.', '', '!', ', see {t}.'])}"
        if kind < 0.36:
            more = self.pick([", ", " and ", " at ", " near ", " with ", " or "]) + self.pick(["{N}", "{G}", "{b}", "{s}", "{c}", "the {1}"]) if self.chance(0.5) else ""
            return f"{done_to} {self.pick(['{N}', '{N}', '{G}', '{b}', 'the {1}'])}{more}{self.pick(['.', '', '?', ', that {3} the {1}.', ' before the {1} {3} it.', ' when you are {2}'])}"
        if kind < 0.45:
            hail, rest = self.pick(self.lists["hails"]), self.pick(["the {1} is {2} again.", "that {3} the {1}", "please check {t}.", "{6} {7} ist {8}.", "le {9} est {10}.", "el {11} está {12}.", "thank you", "", "", "", "which {1} do you mean?", "it {3} the {1}", "no {1} today", "but {1} and {1} differ"])
            whom = self.pick(["{G}", "{G}", "{N}", "", "the {1}"])
            return f"{hail}{' ' if whom else ''}{whom}{',' if rest else self.pick([',', '', '!'])} {rest}".strip()
        if kind < 0.5:
            return f"The {self.pick(['{1}', '{2} {1}'])} {self.pick(['at', 'on', 'near', 'behind', 'along', 'of'])} {self.pick(['{A}', '{s}', '{s}', '{b}', '{c}'])} {self.pick(['is {2}.', '{3} the {1}.', 'was {2} until {d}.'])}"
        return self.pick(self.plain_frames)

    def date(self) -> str:
        m, d, y = 1 + self.below(12), 1 + self.below(28), 2015 + self.below(12)
        return self.pick([f"{y}-{m:02d}-{d:02d}", f"{m}/{d}/{y}", f"{d}.{m}.{y}"])

    def plain(self, slot: str) -> str:
        number = lambda n: str(self.below(n))
        return {
            "b": self.business, "c": self.town, "s": self.street, "g": self.german_street, "n": lambda: number(self.pick([60, 999, 99999])), "d": self.date,
            "t": lambda: self.pick(["TRC-", "LNK-", "INV-", "REQ-", "BUG-"]) + number(99999), "p": lambda: f"{self.digits(3)}-{self.digits(2)}-{self.digits(3)}", "v": lambda: self.pick([f"{number(9)}.{number(9)}.{number(30)}", f"20{number(30):0>2}-{10 + self.below(3)}-{10 + self.below(20)}.{number(3)}"]),
            "o": lambda: self.pick("nwr") + self.digits(self.pick([8, 9, 10])) + self.pick(["", f"@{number(30)}", f"@{number(30)}"]), "u": lambda: "-".join("".join(self.pick("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)), "z": lambda: self.digits(5),
            "x": lambda: f"{self.pick(['', '-'])}{number(180)}.{self.digits(self.pick([2, 5]))}", "r": lambda: self.digits(self.pick([6, 8, 9, 10, 10])), "w": self.made_up, "k": lambda: self.pick(["mapper", "edit", "kiwi", "qa", "bot", "river", "cat"]) + self.digits(2),
        }[slot]()


def _row(frame: str, f: _Filler) -> tuple[str, list[tuple[str, int, int]]]:
    text, spans, kind = "", [], f.r.random()
    if kind < 0.1:
        text = f"[{f.digits(2)}:{f.digits(2)}] {f.plain('k') if f.chance(0.6) else f.one_given().lower() + f.digits(f.below(3))}: "
    elif kind < 0.17:
        text = f.pick(["INFO", "WARN", "DEBUG", "ERROR"]) + f" t={f.digits(4)}ms " + f.pick(["", f'q="{f.street_word()}" ', f'query="{f.street_word()}" ', f"user={f.plain('k')} "])
    elif kind < 0.3:
        text = f.pick([f"#{f.digits(4)}: ", "PS: ", "Also: ", "Note: ", "- ", "* ", f"{f.plain('t')}: ", f"Update {f.date()}: ", "Nota: ", "Hinweis: ", "Remarque : ", "Uwaga: ", f"{f.below(30)}. ", f"Re {f.plain('t')}: ", f"Réf. {f.plain('t')} : "])
    for literal, slot in re.findall(r"([^{]*)(?:\{(\w+)\})?", frame):
        text += literal
        if not slot:
            continue
        if slot in f.words:
            text += f.pick(f.words[slot])
            continue
        if slot not in KIND_OF:
            text += f.plain(slot)
            continue
        if slot in "NG" and len(frame) > 3 and f.chance(0.2):  # nobody where a name could stand, so that a verb alone tells nothing
            nobody = f.pick([f.pick(f.words["15"]), f.pick(f.words["15"]), f"the {f.pick(f.words['1'])}", f"the {f.pick(f.words['2'])} {f.pick(f.words['1'])}", f"{f.pick(f.words['1'])}s", f.pick(f.words["4"]), f.pick(f.words["7"]), f"{f.pick(f.words['6']).lower()} {f.pick(f.words['7'])}", f"le {f.pick(f.words['9'])}", f"la {f.pick(f.words['11'])}"])
            text += nobody if text and text[-1] == " " and f.chance(0.8) else nobody[0].upper() + nobody[1:]
            continue
        if slot == "I":
            text += f.id_words()
        value = ({"P": f.phone, "I": f.id_alone, "J": f.id_alone}.get(slot) or getattr(f, slot))()
        spans.append((KIND_OF[slot], len(text), len(text) + len(value)))
        text += value
        if slot == "P" and f.chance(0.1):
            text += f" {f.pick(['ext.', 'ext', 'x', 'Durchwahl'])} {f.digits(2)}"
        elif slot in "AHFS" and f.chance(0.3):
            text += f.pick([", ", " "]) + f.town() + f.pick(["", "", f" {f.digits(5)}", f", QA {f.digits(5)}"])
    text += f.pick(["", "", "", "", "", f" ({f.plain('t')})", f" (batch {f.digits(5)})", f" see {f.plain('o')}.", " !!", " …", " 👍", f" {''.join(f.pick(LETTERS) for _ in range(2 + f.below(3))).translate(WIDE if f.chance(0.5) else {})}", f" ({f.plain('u')})", f" (#{f.digits(2)})", " [draft]"])
    return text, spans


def labelled_table(given: list[str], rows: int, seed: int, held: bool | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """rows labelled lines (text, spans), some of several sentences as lines in documents are. Same arguments, same rows.

    held: True for the held-out fifth of frames and lists, False for the rest, None for all. Frames that are a slot alone are in
    both parts, as they have no words.
    """
    f = _Filler(given, random.Random(seed), held)
    alone = [x for x in FRAMES if re.fullmatch(r"\{\w\}", x)]
    frames = alone + _part([x for x in FRAMES if x not in alone], held)
    out = []
    for i in range(rows):
        text, spans = _row(frames[i // 2 % len(frames)] if i % 2 else f.made_sentence(), f)
        while f.chance(0.4):
            more, more_spans = _row(f.pick(frames) if f.chance(0.5) else f.made_sentence(), f)
            gap = f.pick([" ", " ", "; ", "\t", "  ", " / "])
            spans += [(k, s + len(text) + len(gap), e + len(text) + len(gap)) for k, s, e in more_spans]
            text += gap + more
        out.append((text, spans))
    return out
