"""Labelled texts for the field of :mod:`strandloom.llm.pii`, made from patterns, and its training.

The patterns are everyday sentences written for this purpose, in English, German
and French; their ordinary words come from public vocabulary files.
"""
from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np

from strandloom.llm.pii import KIND, LABELS, ROUNDS, SKIPS, Field, chain, messages, scores, skip_kind
from strandloom.llm.pii_tokens import BITS, VOCABULARY, Tokens, dictionary, tokenize

#: features seen less often have no weight
LEAST_SEEN = 4

# Common given and family names, and parts of made-up ones.
GIVEN = "James Mary John Linda Robert Susan Michael Karen David Nancy William Emma Thomas Sarah Daniel Laura Peter Julia Paul Claire Henry Alice George Grace Oliver Sophie Jack Chloe Anna Hans Greta Karl Ingrid Jürgen Sabine Klaus Heike Wolfgang Ursula Dieter Petra Pierre Marie Jean Camille Luc Hélène François Élodie Antoine Manon Carlos Lucía Miguel Elena Marco Giulia Olga Ivan Tomasz Agnieszka Mehmet Ayşe Ali Fatima Wei Yuki Hiroshi Priya Arjun Noor Kofi Amara Lars Astrid Sven Freja Mikko Aino Zoltán Eszter".split()
FAMILY = "Smith Jones Taylor Brown Davies Wilson Evans Johnson Roberts Walker Wright Hughes Edwards Clarke Turner Parker Morris Cooper Müller Schmidt Schneider Weber Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Zimmermann Krüger Martin Bernard Dubois Moreau Laurent Lefebvre Girard Roux Fournier Mercier García Fernández López Rossi Russo Bianchi Silva Santos Novak Kowalski Nowak Ivanov Petrov Yılmaz Demir Khan Hussain Patel Singh Chen Wang Zhang Tanaka Suzuki Kim Park Nguyen Tran Okafor Mensah Hansen Larsen Nilsson Virtanen Nagy Szabó".split()
SYLLABLES = "ba be bor bra bri bro cal car chi col da del den dor du ed el fa fen fer fin ga gar gel gil go gra ha har hel hol in ja jor ka kel ki kor la lan lem li lo ma mar mel mi mor na nel ni no ol or pa pel pi ra ren ri ro sa sel si so ste ta tel ti to tor tru u va vel vi vo wa wen wi ya yo za zel".split()
GIVEN_END = "a ah an ar e el en i ia ie il in ine is ka la ley lo na ne nia o on or ra ric s sa ta th us y".split()
FAMILY_END = "ach bach berg bert bury by dahl den dorf er ert eck feld field ford gard ham hof holm hurst inen ini ing ington itz kamp ke ki land ley lin lund man mann mark mer moor more nen ner oni ou ov ová quist rup sen shaw ska ski son stad stein strand thal ton vic vich ville wald well wick wood worth yan".split()
# Surnames that are also ordinary words or name a method, and things named after people.
PLAIN_NAMES = "Young King Baker Cook Fox Hill Stone Field Wood Rose Best Long Short Black White Green Gray Day May Winter Summer Bell Bush Berry Page Price Power Rice Cross Frost Marsh North West Lane Street Rivers Brooks Fisher Student Pearson Bishop Knight Noble Wise Sharp Sommer Kaiser König Lang Gross Jung Kraft Stark Vogel Fuchs Petit Blanc Roche Fontaine".split()
EPONYMS = "Fisher|Student|Wilcoxon|Pearson|Spearman|Kruskal-Wallis|Mann-Whitney|Kaplan-Meier|Tukey|Bonferroni|Benjamini-Hochberg|Welch|Gauss|Bayes|Markov|Euler|Fourier|Laplace|Poisson|Cox|Cohen|Shannon|Jaccard|Giemsa|Golgi|Nissl|Gram|Masson|Wright|Kupffer|Schwann|Sertoli|Leydig|Langerhans|Purkinje|Paneth|Hodgkin|Alzheimer|Parkinson|Crohn|Krebs|Calvin|Ringer|Bradford|Petri|Bunsen|Eppendorf|Falcon|Neubauer|Southern|Northern|Western|Venn|Likert|Doppler|Geiger|Kelvin|Ziehl-Neelsen".split("|")
THINGS = "test|tests|plot|plots|cells|cell|stain|stains|staining|method|methods|score|scores|index|curve|curves|blots|correction|disease|syndrome|equation|layer|gland|reaction|buffer|solution|blot|body|bodies|criterion|estimate|distribution|tube|dish|chamber|diagram|effect|cycle|assay|scale|model|transform|coefficient".split("|")
TECHNICAL_END = "is us um ar oris orum ens ix al ane ary ase ated ation ed er eum ia ial ic ide in ine ing ise ised ism ite itis ium ive ized ly ment ol on one ose osis ous um us yl".split()
STREET = "Street Road Avenue Lane Drive Close Court Mews Terrace Way Crescent Square Grove Hill Walk Row Gardens Parade Place Boulevard St. Rd. Ave. Ln. Blvd. St Rd Ave".split()
STRASSE = "straße strasse str. weg allee ring gasse platz damm ufer steig".split()
RUE = "rue quai avenue boulevard chemin allée impasse cours route passage place".split()
RUE_WORDS = "de la |du |des |de l'|de |d'|||".split("|")
RUE_ADJECTIVES = "Vieux Vieille Grand Grande Petit Petite Saint Sainte Beau Belle Haut Haute".split()
PARTICLES = "van|de|von|van der|van den|de la|di|da|del|ter|zu|al|el|bin|le|Van|De|Le|Von".split("|")
ID_LABELS = "SSN|social security number|social security no.|Soc. Sec. No.|national insurance number|NI no.|NINO|passport|passport no.|passport number|ID card|ID card no.|identity card|identity number|national ID|personal number|personal ID|civil registration number|civil reg. no.|CPR|tax ID|tax number|driving licence|driver's license|residence permit|Personalausweis|Ausweis|Ausweisnummer|Ausweis-Nr.|Reisepass|Sozialversicherungsnummer|Steuer-ID|carte d'identité|numéro de passeport|passeport|carte nationale|numéro de sécurité sociale|titre de séjour".split("|")
CONTEXTS = r"""{N} joined the team in March.
I spoke with {N} about the budget.
The meeting was chaired by {N}.
Our new manager is {N}.
Please forward this to {N} when you can.
{N} will be away until Thursday.
Minutes taken by {N}.
Photos courtesy of {N}
Reported by: {N}
Author: {N}
Name: {N}
Patient: {N}, born in 1962
Witness {N} confirmed the story.
My neighbour {N} has the spare key.
We met {N} and {N} at the station.
Dear Mr {F},
Dear Mrs {F},
Dear Dr. {F},
Dear Professor {F},
Dear {N},
Hi {G},
Hello {G},
Dear {G},
Sincerely,\n{N}
Yours,\n{N}\n{P}
All the best,\n{N}\n{E}
Greetings,\n{G}
Many thanks\n{N}
Take care,\n{G}
Yours faithfully,\n\n{N}\n{A}\n{T}
Sent by {N} <{E}>
To: {N} <{E}>; Cc: {N} <{E}>
From: {N} <{E}>
Signed, {N}
Approved by {N} on behalf of the board.
Mr {F} and Mrs {F} are expected at noon.
{F} agreed.
{F} will bring the {w}.
as {F} told {F}
the {w} that {F} wrote
{F} and {F} shared the {w}.
see {F} about the {w}
{F} to {F}: {w} {w}
thank {F} for the {w}
a call from {F}
Tell {F} that the {w} is {w}.
{N}, {N} and {N} took part.
{W} was done by {N}, {w} by {N}.
the {w} of {N} and the {w}
{w} {w} {w} by {N}.
{N} did the {w}; {N} the {w}.
{N} noted: {w} {w}
Ms {F} or Mr {F}
Miss {N} teaches the class.
Dr {F} looked at the knee.
Dr. {N} is on call tonight.
Prof. {F} retires soon.
Prof. Dr. {N} gave the lecture.
as Professor {N} explained
Ms {F} has the floor.
thanks to {N} for proofreading
{N}'s office is upstairs.
{N}: I will send the draft tonight.
Shift leader {N} locked the door.
The parcel for {N} is at reception.
a letter from {N} arrived
owner: {N}
assigned to {N}
reviewer = {N}
Attendees: {N}; {N}; {N}
Present were {N} and {N}.
Delivered to {N} at {A}
{N} has a flat at {A} in {T}.
The volunteer, {N}, changed her mind.
The tenant, {N}, moved out.
Mother of the child: {N}
The bag was carried by {N} himself.
Painted by {N}; printed in {T}.
Music by {N}; words by {N}.
Check with {N} first.
Ring {N} if it rains.
Ask for {N} at the desk.
copy to {N}
in memory of {N}
{N} said so twice.
{N} asked whether {w} {w} would do.
so {N} paid for {w}.
Behind {N} stood a {w} {w}.
Handover by {N} on Friday.
prepared by {N} for {w} {w}
{N} owns the {w}.
Invoice address: {N}, {A}, {T}
Home address {A}, {T}
We moved from {A} to {A}.
Office: {A} | Phone: {P} | Mail: {E}
The shop at {A} closes at six.
send it to {A}
Meet at {A} tomorrow.
Where: {A}, {T}
Parcel locker near {A}.
She grew up at {A}, {T}.
Deliver the {w} to {A}, {T}, before ten.
The {w} is kept at {A} in {T}.
He lives in {T}, {A}.
Collect the {w} from {A}.
{A}, 3rd floor
{A}, flat 4, {T}
{A}\n{T}
Emergency contact: {N}, {P}
Reach me at {P} or {E}.
My number is {P}.
Please ring {P} after six.
tel: {P}
Fax: {P}
cell {P}
Phone: {P}
Phone {P}, ext. 7
Phone {P} x204
hotline {P}
WhatsApp {P}
Dial {P} and ask for the duty officer.
Her old number is gone, use {P} instead.
Any trouble? Call {P}.
call {P} when the {w} {w}
text me on {P}
Reception can be reached on {P} all night.
On weekends: {P}
Email: {E}
e-mail {E}
mail me: {E}
You can write to {E}.
Subscribe at {E} for news.
For details contact {E}.
<{E}>
mailto:{E}
reply-to {E}
Forms go to {E}, please.
Address ({E}) unchanged.
Please use {E} from now on.
{E} bounced again.
or drop a line to {E} by Monday.
the {w} {w} is available from {E}
My {L} is {I}.
{L} {I}
{L}: {I}
{L} = {I}
{L} ({I})
He travels with {L} {I}.
The form shows {L} {I}.
Please quote your {L}, {I}, in all letters.
Visitor with {L} {I} was let in.
A copy of {L} {I} is on file.
{N}, {L} {I}
under {L} {I} only
Mit freundlichen Grüßen\n{N}
Mit besten Grüßen\n{N}\n{P}
Sehr geehrte Frau {F},
Sehr geehrter Herr {F},
Lieber {G},
Liebe {G},
Guten Tag Herr {F},
{N} übernimmt die Vertretung.
Der Vortrag wird von {N} gehalten.
Ansprechpartner: {N}
Ansprechpartnerin ist {N}, Telefon {P}.
Bei Fragen hilft {N} weiter ({E}).
Herr {N} ist im Urlaub.
Frau Dr. {F} leitet die Abteilung.
Ich habe mit {N} gesprochen.
Das Paket nahm {N} an.
Die Schlüssel hat Frau {N}.
Bitte an Herrn {F} weitergeben.
Wohnhaft {A}, {T}.
Anschrift: {A}
Treffpunkt: {A}, {T}
Besuchen Sie uns: {A}.
Das Lokal liegt hier: {A} in {T}.
Die Post geht an {A}, {T}.
Telefon: {P}
Tel.: {P}
Mobil {P}
Rufen Sie {P} an.
erreichbar unter der Nummer {P}
Telefonisch: {P} (abends)
Schreiben Sie an {E}.
Anfragen über {E}.
E-Mail: {E}
{L} {I} liegt vor.
Auf dem Bogen steht {L} {I}.
Cordialement\n{N}
Bien à vous,\n{N}
Madame {F},
Monsieur {N} est absent.
Bonjour {G},
Chère {G},
M. {F} a signé.
Mme {F} arrive demain.
Le rendez-vous avec {N} est reporté.
Responsable : {N}
Rédigé par {N}
Merci à {N} pour son aide.
J'ai parlé à {N}.
Le colis a été reçu par {N}.
Prévenir M. {N} avant samedi.
Demander à Mme {N}.
Il habite {A} à {T}.
Adresse : {A}, {T}
Livraison au {A}
On se retrouve au {A}, {T}.
Téléphone : {P}
Tél. {P}
Joindre le {P}
Portable : {P}
Appelez le {P} en cas de retard.
Courriel : {E}
Écrire à {E}
Contact : {E}
Renseignements auprès de {E}.
{L} : {I}
Le dossier indique {L} {I}.
{"name": "{N}", "email": "{E}", "phone": "{P}"}
{"user": "{N}", "street": "{A}", "city": "{T}"}
last_name: {F}; first_name: {G}; mail: {E}
owner_name: {N}; owner_phone: {P}; owner_addr: {A}
name={N};tel={P};city={T}
user: {N}\nmail: {E}\nphone: {P}\naddress: {A}, {T}
| {N} | {P} | {E} |
{N}\t{E}\t{P}
{N}; {A}; {T}
{N}\n{A}\n{T}
{N}\n{E}\n{P}
{N}\n{A}, {T}\nphone: {P}\n{E}
--\n{N}\n{E} · {P}
--\n{N} | {P}
{N} | {E}
{N}\n{T}
{N} ({T})
{w} {w} {P} {w} {w}
{W} {w} {P}.
{w} {w}: {P}; {w}
{W} {P} {w} {w} {w}.
{w} {w} {E} {w}
{W} {w} {w} {E}.
{w} {w} {A} {w} {w}
{W} {w} {A}.
{w} {w} {A}, {T}, {w}.
{W} {w} {w} {A}. {W} {w} {w}.
{W} {w} {w} {A}\n{W} {w} {w}.
{w} {w} {w} {N} {w} {w}.
{W} {N} {w} {w} {w}
{w} {w} {N}. {W} {w} {w}.
{w} {w}, {N}, {w} {w}
{W} {w} {w} {N}
{N} {w} {w} {w}.
{w} {w} {N} and {N} {w}
{W} {w} {w} {w} {N}.
{N} {V} {w} {w}.
{N} {V} the {w} {f} {w}.
{F} {V} {w}.
Then {N} {V} the {w}.
{v} {N} {f} {w}
The {w}, {N}, {V} {w}.
the {w}, {N}, {V} {f} {w}
{W} {w}, {N}, {w} {w}
{w}: {N}; {w}: {w}
{w}: {N}, {w} {w}
{w} {N}
{w}: {N}
{w}_{w}: {N}; {w}_{w}: {E}
{W} {V} {N} {w}.
{y} {D} {w} {N} {w}.
{f} {N} {f} {d} {w}
{v} {N} {w}.
{v} {F} {f} the {w}.
please {v} {N}
Prof. {F} {V} it.
Dr. {F} {V} the {w}.
Mr. {F} {V} {w}.
Mrs. {N} {V} {w} {w}
Das {D} brachte {N} vorbei.
{y} {D} holte {N} {w}
{N} hat {y} {D} {w}.
{y} {D} von {N} {w}
Frau {F} und Herr {F} {w} {y} {D}.
{y} {D} gehört {N}.
{N} a {w} le {w}.
le {w} de {N}
{w} {L} {I} {w} {w}
{W} {w} {w} {L} {I}.
{W} {w} {w} {w} {L} {I} {w} {w}.
{w} {w} {L} {w} {I} {w}
{L} {I}, {w} {w}""".split("\n")
#: sentences that say little by themselves; the same frames hold names and other words
WEAK = r"""Later {X} turned up again.
Nothing more was heard of {X}.
This time {X} was {w}.
{X} again, as before.
{X} {w} the {w} and left.
The {w} of {X} was {w}.
They likened {X} to a {w}.
{w} and {X} {w}
In the end {X} was right.
Puis {X} a changé.
Danach kam {X}.
For {X} see below.
{X}, {w} {w}
without {X} the {w} {w}
around {X}""".split("\n")
INTRODUCED = r"""The {X} device was switched on.
They bought a {X} engine.
a box of {X} powder
The ship {X} sailed from {T}.
The {X} company builds {w} {w}.
{X} is a small town.
The village of {X} lies north.
The software {X} was installed.
Die Firma {X} liefert {w}.
La ville de {X} est petite.""".split("\n")
PLAIN = r"""The reaction ran for {d} minutes at {d} degrees.
Table {d} lists all values; see page {d}.
Version {d}.{d}.{d} fixed the crash.
The train leaves at {d}:{d2} from platform {d}.
Invoice {d6} was paid on the {d}th.
Order no. {K}-{d4} shipped; order {d3}-{d4} did not.
Serial {K}{d5}-{d3}, part number {d3}-{d4}-{d2}.
Part no. {d3}-{d4}-{K} fits.
Lot {d6} and lot {K}{d7} were returned.
Catalogue number {d3}-{d4}-{d4}, item {K}{d4}.
Ref. {d8}, batch {d9}.
record {d9}
build {d9} failed
case {d3}-{d2}-{d4} closed
ticket #{d5}, ticket {d6}-{d4}
ISBN {d3}-{d1}-{d5}-{d3}-{d1}
doi 10.{d4}/{w}.{d4}
host {d3}.{d3}.{d2}.{d1} is down
the accession {K}_{d6} and entry {K}{d7}
it was {d}.{d} °C
region {d1}:{d8}-{d8}
p = 0.{d3}, n = {d}, r = 0.{d2}
{d2}.{d4}, {d2}.{d4} on the map
a budget of {d3},{d3} euros
Room {d3}, Building {K}, Level {d}
Gate {d} West, Row {d}, Seat {K}
Shelf {d} Court side; Drawer {d} Lane {d}
from {d} to {d} in 2019
on 2021-{d2}-{d2} at {d2}:{d2}:{d2}
2{d3}-{d2}-{d2}T{d2}:{d2}:{d2}
run {d3} lane {d} tile {d4}
@{w}_{w} posted it at {d}:{d2}
see http://www.{w}.org/{w}/{w} or https://{w}.example.com/{w}?id={d4}
{w}.{w}({w}) returned {d}
a ratio of {d}/{d4} or {d3}/{d5}
weights {d3} {d2} {d4} {d2}
The values are {d3} {d3} {d4} and {d2} {d2} {d2} {d2}.
{d}. {W} {w}\n{d}. {W} {w}
A {S} {s} was used.
The {S} {s} and the {S} {s} agree.
by the {S} {s}, after {S}
{S} {s} were counted on {S} slides.
corrected after {S} and {S}
in a {S} {s} of the {w}
{W} {S} {s}, {w}
The parcels went from {T} to {T}.
in {T} and {T}
a hotel in {T}
University of {T}
the {T} Institute of {W}
the {W} {W} Foundation
{W} {W} Ltd.
the {W} of {W} and {W}
{W} {W}: {w} {w} {w}
{W}: {W} {W}
# {W} {W} {W}
The {W} {w} was {w}.
The {g} gene and {g} in {w}.
{g}, {g} and {g} were {w} in {w}.
{g} rose {d}-fold, {g} fell.
In {w}, {g} {w} {w} {g}.
{W} {g} {w}: {g}, {g}
both {g} and {g} {w}
{g} or {g}: {w} {w}
{g} {w} the {w} while {g} {w}
the {w} of {g} was {w}; {g} {w}
{w} {g} {w} {w} {g} {w}
that {g} {w} and {g} {w}
of {g}, {g} and {g}
{g} is {w}, and so is {g}.
when {g} {w}, {g} {w} {w}
{w} for {g} and {g} in {w}
The {g}-{w} {w}
{W} {U} {w} and {U}
{U} {w}, {U} {d} and {w}
A {w}-{w} {w} of {w}-{w} {w}
{w}, {w}, {w}, {w} / {w}, {w}
{w}; {w} {w}; {W}, {w}
{W} and, {w}; {w} or {W}, {w}
{W}, {w} {W} {w}
{w}
{w} {w}
{W}
{w}: {w}, {w}: {w} {w}
{w}_{w}: {w} {w}; {w}_{w}: {w}
{w}={d};{w}={w}
{K}{d4} {w} {K}-{d6}
{K} {d2} {w}, {K} {d}
rack {K} {d}, box {K} {d2}
{d9} {w} and {d8} {w}
{d6}-{d4} is the {w} of lot {d6}
{d3}-{d2}-{d4} {w} {w}
the {w} {d3}-{d3}-{d2}, the {w} {d3}-{d3}
{d3}.{d3}.{d4} and {d2}.{d2}.{d2}
count {d9}, seed {d6}, hash {d7}
{w} at {w} dot {w}
{W} {B} {f} {w} {w}
{w} {B} {w} {f} {B}.
{B} {w} {B}
{W} {B} {V}
am {D} {w} {y} {D}
im {D} und {D}, zum {D}
vom {D} {w} {w} {y} {D} und {D}.
{w} {f} {g} {w}
{w} {w} {f} {g} {f} {w} {w}
{f} {g} {w} {f} {w}
{w} {f} {g} {f} {g}, {w}
{w} {f} {g} {V}.
{g} {V} {w} {f} {g} {V}
{w} more {w} than {g} {V}
{V} by {g} and {w} {V}
{w} {w} by {g}; {w}
{d} {Y} {w} {d}.{d} {Y}
{w} {d}{Y}, {Y} {w}
{y} {y} {D} {w} {y} {D}
{D} {w} {y} {D}, {y} {y} {D}.
{y} {D} {w} {y} {y} {D} {w}
{D} {y} {D}
{y} {y} {y} {D}
{W} {w} {y} {D}. {y} {D} {w}
"{w} {w} {w}": {w}
"{W}, {w} {w}"
'{W} {w}' or '{w} {w}'
{f} '{W}' {w}
{w} {K}. {W} {w} {w}
{w} {w} {d} {K}. {W} {w} {w}.
{W} and {S} {s} {V}.
{S} and {S} {s} {w} {V}.
{S} {s} {V} {w}
{d3} {w} {w}. {W} {w}
{d} Lane {w}, {d} Street {w} and {d} Court
{W} {d} Way {w}; {d} Place {w}
{d} {W} {w} {d}
{W} {d} {W}, {w} {d}
{w}'s {w} isn't {w}; it's {w}
{W}'s {w}
l'{w} d'{w} {w}
L'{w} de {w} {w}
{S}'s {w} {s}
{w} {R} {w} {w}
{W} {R} and {R} {w} {w}.
{w} no. {R} {w}
{w}: {R}; {w} {R}
the {w} {R} of {w} {R}
{R} {w}
{w} {w} {d8} {w}
{W} {d8}, {W} {d8}
{K} {d8} or {K}{d8}
The {w} {w} of {w} were {w} and {w}.
{W} {w}, {w} and {w} grew out of {w} {w}.
Every {w} {w} and {w} {w} by {w} is listed.
It failed through {w} {w} from {w} {w} of {w}.
{W} {w} the {w} {w} by {w}, {w} by {w}.
This {w} {w} {d} {w} with {w} {w} for {w} {w}, and {w} {w}.
If {w} {w} {w}, then {w} {w} {w}; otherwise {w}.
What {w} {w} {w} the {w}?
Which {w} would {w} {w} when {w} {w}?
Why does {w} {w} {w}?
{W} {w} {w}?
Explain how {w} {w} {w} {w}.
Describe the {w} of {w} in {d} {w}.
{d} {w} were {w} with {d} {w} {w}.
{w} ({w}), {w} ({W}) and {w}
({w} {w} {w}; {w})
"{W} {w} {w}," they said.
“{W} {w}” was {w}.
We {w} {d} {w} of {w}. {W} {w} was {w} by {w}.
They {w} that {w} {w} {w}, as {w} by {w} {w}.
each {w} was kept by {w} {w} in the {w}
handled by two {w} {w} on {w}
Sorted by {w}; {w} by {w}.
as {w} has it, {w} was {w}
from {w}: {w}, {w}; {w}
from the {W} {w} of the {W}
please {w} {w} before {w}
ask {w} {w}; contact {w}
Dear all,
Dear colleagues, {w} {w} {w}.
Hello everyone,
Hi team,
Cheers to all
With compliments
Thanks in advance,
To whom it may concern
Note: {w} {w}
Warning: {w} {w} {w}
TODO: {w}
FAQ {d}: {w}
- {w} {w}\n- {w}
* {W} {w}\n* {W}
{K}{d}-{d} and {K}{d}/{d}
unit {K}{d}a, well {K}{d}
Monday and Tuesday in January
Die {W} kam nach {d} Tagen zurück.
Das {W} ist neu, die {W} nicht.
In der {W} lagen {d} {W}.
Der {W} zeigt die {W} im {W}.
Alle {W} wurden am {d}. Mai geliefert.
Je {W} standen {d} {W} bereit.
Nach {d} Stunden war der {W} leer, die {W} nicht.
Rund {d} Stück {W} fehlten.
Bestellung {d6}, Artikel {d3}-{d4}.
von {W} bis {W}
Wir danken allen Helfern.
Liebe Kollegen,
Viele Grüße aus {T}
Im {W} stand die {W} neben dem {W}.
Die {S}-Methode wurde verwendet.
Après {d} jours, le {w} était {w}.
Les {w} sont {w} par {w}.
Chaque {w} contient {d} {w}.
Environ {d} {w} sur {d}
Commande {d6}, article {d3}-{d4}.
La méthode de {S} a été suivie.
Le {w} de {T} est fermé.
Chers collègues,
Merci à tous.
Bonjour à toutes et à tous,""".split("\n")
ACRONYMS = "DNA RNA mRNA PCR ATP MRI CT UV IR USB PDF URL HTML NASA WHO EU USA UK UN GPS LED LCD CPU RAM PH CO VIP FAQ TV HIV".split()
GERMAN = "Haus Boden Tag Jahr Woche Monat Zeit Wasser Luft Licht Feuer Erde Tisch Stuhl Fenster Tür Wand Dach Keller Garten Wald Berg Fluss See Stadt Land Dorf Weg Schiff Zug Wagen Rad Buch Blatt Brief Bild Karte Liste Wort Satz Zahl Wert Frage Antwort Regel Grund Ende Anfang Mitte Rand Seite Teil Hälfte Stück Gruppe Reihe Menge Kiste Flasche Glas Papier Holz Stein Metall Tier Maus Hund Katze Vogel Fisch Pflanze Kopf Hand Fuß Herz Auge Ohr Haut Blut Leber Niere".split()
VERBS = "said wrote left came went kept sent made took brought opened closed packed checked signed called found gave showed ran read met heard built fixed moved drew paid held sold lost won told asked tried wanted started stopped helped".split()
TELL = "tell ask remind invite thank inform notify call see meet warn pay follow join help trust visit email text phone involve consult brief".split()
UNITS = "mGy kHz mL dB kPa µL mM nM kDa MHz GB mV kB cGy kcal mmHg MBq rpm kg cm µg hPa lx".split()
GERMAN_END = "e en er ung ungen heit keit schaft tion ator nis tum ling ei tät zeit wert probe blatt raum teil stück satz gang lauf druck stoff maß plan".split()
GERMAN_SMALL = "der die das dem den des ein eine einer einem eigenen neuen ersten letzten jeder jede alle beiden gleichen großen kleinen mit von in auf für aus bei nach über unter ohne je pro".split()
FUNCTION = "the a of in and to for with by from at on was were is are be been has have had not no as that this these those it its their our his her one two three more less than then when while after before under over into about but or if so because which who what how all any each some most other same new old first last".split()
_words: list[str] = []


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _made(r: random.Random, ends: list[str]) -> str:
    return ("".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2)))) + r.choice(ends)).capitalize()


def given(r: random.Random) -> str:
    g = r.choice(GIVEN) if r.random() < 0.4 else _made(r, GIVEN_END)
    return g if r.random() < 0.96 else g + "-" + r.choice(GIVEN)


def family(r: random.Random) -> str:
    x = r.random()
    f = r.choice(PLAIN_NAMES) if x < 0.14 else r.choice(_words or FAMILY).capitalize() if x < 0.24 else r.choice(FAMILY) if x < 0.42 else _made(r, FAMILY_END)
    if r.random() < 0.1:
        f += "-" + _made(r, FAMILY_END)
    if r.random() < 0.06:
        f = r.choice(PARTICLES) + " " + f
    elif r.random() < 0.05:
        f = r.choice(("O'", "O’", "D'", "Mc", "Mac")) + f
    return f


def technical(r: random.Random) -> str:
    """A made-up word of the kind no general vocabulary has."""
    w = ("".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 2, 2, 3)))) + r.choice(TECHNICAL_END)).lower()
    return w if r.random() < 0.85 else r.choice("re un de pre non sub over inter".split()) + r.choice(("", "-")) + w


def german(r: random.Random) -> str:
    """A common or made-up noun with a capital."""
    return r.choice(GERMAN) if r.random() < 0.4 else ("".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2)))) + r.choice(GERMAN_END)).capitalize()


def word(r: random.Random) -> str:
    """A function word, one of the public vocabularies, a compound, or a made-up technical one."""
    if not _words:
        _words.extend(dictionary(VOCABULARY))
    x = r.random()
    return r.choice(FUNCTION) if x < 0.3 else r.choice(_words) if x < 0.75 else technical(r) if x < 0.95 else r.choice(_words) + "-" + r.choice((r.choice(_words), technical(r)))


def town(r: random.Random) -> str:
    p = r.choice("London Paris Berlin Hamburg Lyon Oslo Boston Madrid Vienna Leeds Bonn Lille Turin Denver".split()) if r.random() < 0.25 else _made(r, "field wick holm fen mere stadt brunn dorf ville ton by burg ford".split())
    return r.choice(("Port ", "New ", "Bad ", "St. ", "Saint-")) + p if r.random() < 0.12 else p


def person(r: random.Random, who: tuple[str, str] | None = None) -> str:
    g, f = who or (given(r), family(r))
    i = r.choice("ABCDEFGHIJKLMNOPRSTVWZ")
    if r.random() < 0.06:
        return f"{g}{r.choice(('  ', chr(10), chr(10), chr(9)))}{f}"
    return r.choice([f"{g} {f}"] * 8 + [f"{g} {i}. {f}"] * 2 + [f"{i}. {f}"] * 3 + [f"{i}.{r.choice('ABEGKMS')}. {f}"] + [f] * 3 + [f"{f}, {g}"] * 4)


def address(r: random.Random) -> str:
    n, w = str(r.randint(1, 260)), r.choice([_made(r, FAMILY_END + "er en ow ock".split())] * 3 + [word(r).capitalize()] * 2 + [r.choice(PLAIN_NAMES), r.choice(GIVEN)])
    x = r.random()
    if x < 0.55:
        side = r.choice(["", "", "", "Old ", "North ", "New ", "Upper ", r.choice("NSEW") + ". ", _made(r, GIVEN_END) + " "])
        return f"{n}{r.choice(['', '', '', 'A', 'b', ' C', ','])} {side}{w} {r.choice(STREET)}"
    if x < 0.78:
        s = r.choice(STRASSE)
        return r.choice([f"{w}{s}", f"{w}{s}", f"{w} {s.capitalize()}", f"{w}-{s.capitalize()}", f"Am {w}", f"{_made(r, GIVEN_END)}er {s.capitalize()}"]) + f" {n}{r.choice(['', '', ' c', 'a', ' b', 'A', '-' + str(int(n) + 2)])}"
    return f"{n}{r.choice(['', '', ' bis', ' ter', ',', 'B'])} {r.choice(RUE)} {r.choice(RUE_WORDS)}{r.choice(['', '', r.choice(RUE_ADJECTIVES) + ' '])}{w}" + r.choice(["", "", "", " " + _made(r, GIVEN_END)])


def email(r: random.Random) -> str:
    part = lambda: r.choice([_made(r, FAMILY_END).lower(), word(r)])
    g, f = (r.choice(GIVEN) if r.random() < 0.3 else _made(r, GIVEN_END)).lower(), _made(r, FAMILY_END).lower()
    g = g if g.isascii() else "anna"
    local = r.choice([f"{g}.{f}", f"{g}.{f}", f"{g}_{f}", f"{f}{r.randint(1, 99)}", f"{g[0]}{f}", f"{f}-{g}", f"{g[0]}.{f}", f"{g}", f"{part()}", f"{g}.{f}{r.randint(1, 999)}", f"{g[0]}.{g[-1]}.{f}"])
    if r.random() < 0.12:
        local += "+" + part()
    at = r.choice(["@"] * 7 + [" [at] ", "(at)", " at ", "[at]", " (at) ", " {at} ", " @ "])
    dot = "." if at in ("@", " @ ") else r.choice([".", " dot ", "(dot)", " [dot] ", "[dot]", " (dot) "])
    if at == " at ":
        dot = " dot "
        local = r.choice([local, local.replace(".", " dot ")])
    end = r.choice("com org net edu de fr uk eu info test invalid example ch io gov".split())
    hosts = [r.choice([part(), part() + "-" + part(), part() + str(r.randint(1, 9)), r.choice("mail uni dept core lab web post".split())]) for _ in range(r.choice((1, 1, 2, 2, 3)))]
    return local + at + dot.join([*hosts, end])


def phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    n = lambda: "2345678"[r.randint(0, 6)] + d(2)
    cc = r.choice("1 7 20 30 31 32 33 34 39 41 43 44 45 46 47 48 49 61 81 90 351 353 358 420".split())
    s = r.choice([" ", " ", "-", "."])
    return r.choice([
        f"+{cc} {d(2)} {d(4)} {d(4)}", f"+{cc} {d(2)} {d(5)} {d(3)}", f"+{cc} {d(3)} {d(3)} {d(3)}", f"+{cc} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{cc}{d(9)}", f"+{cc}{d(10)}", f"+{cc} ({d(3)}) {d(3)}-{d(4)}", f"+{cc} (0){d(2)} {d(7)}",
        f"+{cc}-{d(3)}-{d(3)}-{d(4)}", f"+{cc} {d(4)} {d(6)}", f"00{cc} {d(2)} {d(7)}", f"00{cc} (0){d(2)} {d(8)}", f"00{cc} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({n()}) {d(3)}-{d(4)}", f"({n()}) {d(3)} {d(4)}", f"{n()}{s}{d(3)}{s}{d(4)}", f"{n()}-{d(3)}-{d(4)}",
        f"1{s}{n()}{s}{d(3)}{s}{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(3)} {d(6)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)}/{d(7)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(3)}-{d(6)}", f"0{d(3)}/{d(5)}", f"(0{d(3)}) {d(5)}",
    ])


def idnum(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    a = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTVXYZ") for _ in range(n))
    return r.choice([
        f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), d(9), f"{d(6)}-{d(4)}", f"{d(6)}-{d(4)}", f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}", f"{a(2)}{d(6)}{a(1)}", f"{a(1)}{d(8)}", f"{a(2)}{d(7)}", f"{a(1)}{d(7)}",
        f"{a(2)}-{d(7)}-{a(1)}", f"{a(1)}-{d(7)}-{a(1)}", f"{a(3)}{d(6)}", d(11), f"{d(2)} {d(6)} {a(1)} {d(3)}", f"{d(8)}{a(1)}", f"{d(8)}-{a(1)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}",
    ])


def number(r: random.Random) -> str:
    """Groups of digits, perhaps with letters, in a form that no personal number has."""
    while True:
        mark = r.choice("-./-")
        parts = [_digits(r, r.randint(1, 8)) for _ in range(r.randint(1, 4))]
        if r.random() < 0.25:
            parts.append("".join(r.choice("ABCDXYZ") for _ in range(r.randint(1, 3))))
        if r.random() < 0.15:
            parts.insert(0, "".join(r.choice("ABCDXYZ") for _ in range(r.randint(1, 3))))
        form = mark.join(p if p.isalpha() else str(len(p)) for p in parts)
        if form not in ("3-2-4", "6-4", "9", "3-3-4", "3.3.4", "3-4", "2.2.2.2.2", "3/7", "3/5-3", "4/5", "4-6", "8", "11", "7") and not re.fullmatch(r"[A-Z]+-7-[A-Z]", form):
            return mark.join(parts)


def gene(r: random.Random) -> str:
    s = "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.choice((1, 1, 2)))) + r.choice("lmnrxzt")
    s = s if r.random() < 0.6 else "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 2)))) + r.choice("a in on ol ex ix um yl en".split())
    s = s.upper() if r.random() < 0.15 else s.capitalize()
    return s + r.choice(["1", "2", "8", "12", "a1", "b3", "lin", "ta", "in", "sa", "", "", "", "-2", "d"])


SLOTS = {"N": "name", "F": "name", "G": "name", "E": "email", "P": "phone", "I": "idnum", "A": "address"}
_PART = re.compile(r"(\{[A-Za-z]\d?\})")


def filled(pattern: str, r: random.Random, who: list[tuple[str, str]], thing: str = "") -> list[tuple[str, str]]:
    """(text, label) pieces of a pattern; ``who`` are the text's people, some of whom come again."""
    if r.random() < 0.3:
        pattern = re.sub(r"\b(Dr|Prof|Mr|Mrs|Tel|No|no|Tél)\.", r"\1", pattern)
    pieces: list[tuple[str, str]] = []
    for part in _PART.split(pattern.replace("\\n", "\n").replace("\\t", "\t")):
        m = part[1:-1] if _PART.fullmatch(part) else ""
        if not m:
            pieces.append((part, "O"))
        elif m[0] in "NFG":
            if not who or r.random() < 0.5:
                who.append((given(r), family(r)))
            g, f = r.choice(who)
            pieces.append((person(r, (g, f)) if m == "N" else f if m == "F" else g, "name"))
        elif m[0] in SLOTS:
            pieces.append(({"E": email, "P": phone, "I": idnum, "A": address}[m[0]](r), SLOTS[m[0]]))
            if r.random() < 0.2:
                more = " ".join(word(r) for _ in range(r.randint(1, 3)))
                pieces.append((r.choice((" " + more, " " + more, ". " + more.capitalize() + " ", "\n" + more.capitalize() + " ", ".\n" + more.capitalize() + " ")), "O"))
        elif m[0] == "d":
            pieces.append((_digits(r, int(m[1])) if len(m) > 1 else str(r.randint(1, 99)), "O"))
        else:
            pieces.append(({
                "T": lambda: town(r), "L": lambda: r.choice(ID_LABELS), "w": lambda: word(r), "W": lambda: word(r).capitalize(), "g": lambda: gene(r), "S": lambda: r.choice(EPONYMS), "s": lambda: r.choice(THINGS),
                "K": lambda: "".join(r.choice("ABCDEFGHKLMNPQRSTXZ") for _ in range(r.choice((1, 2, 2, 3)))), "X": lambda: thing, "U": lambda: word(r).upper(), "R": lambda: number(r), "f": lambda: r.choice(FUNCTION), "V": lambda: r.choice(VERBS), "v": lambda: (lambda x: x.capitalize() if r.random() < 0.5 else x)(r.choice(TELL)), "Y": lambda: r.choice(UNITS), "B": lambda: r.choice(ACRONYMS), "D": lambda: german(r), "y": lambda: r.choice(GERMAN_SMALL),
            }[m[0]](), "O"))
    return pieces


def document(r: random.Random, contexts: list[str], plain: list[str]) -> list[tuple[str, str]]:
    """Pieces of a text of one to five sentences."""
    who: list[tuple[str, str]] = []
    thing = _made(r, FAMILY_END)
    out: list[tuple[str, str]] = []
    join = r.choice([" ", " ", "\n", "\n\n", "\n- "])
    told = False
    parts: list[list[tuple[str, str]]] = []
    for _ in range(r.randint(1, 5)):
        x = r.random()
        if x < 0.12 and (who or told):
            if who and (not told or r.random() < 0.5):
                f = r.choice(who)
                frame = r.choice(WEAK).split("{X}")
                parts.append([*filled(frame[0], r, []), (r.choice([f[1], f[1], f"{f[0]} {f[1]}"]), "name"), *filled(frame[1], r, [])])
            else:
                parts.append(filled(r.choice(WEAK), r, [], thing))
        elif x < 0.2:
            told = True
            parts.append(filled(r.choice(INTRODUCED), r, [], thing))
        else:
            parts.append(filled(r.choice(contexts if x < 0.58 else plain), r, who))
    for i, p in enumerate(parts):
        if i:
            out.append((join, "O"))
        x = r.random()
        turn = str.upper if x < 0.1 else str.lower if x < 0.22 else None
        only = r.random() < 0.6 and any(k != "O" for _, k in p)  # else the whole sentence is turned
        out += [(turn(t) if turn and (k != "O" or not only) else t, k) for t, k in p]
    return out


def labelled(count: int, seed: int, contexts: list[str] | None = None, plain: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the places of their personal information."""
    r = random.Random(seed)
    out = []
    for _ in range(count):
        text, gold = "", []
        for piece, kind in document(r, contexts or CONTEXTS, plain or PLAIN):
            if kind != "O" and piece:
                gold.append((len(text), len(text) + len(piece), kind))
            text += piece
        out.append((text, gold))
    return out


def gold_labels(at: np.ndarray, t: Tokens, golds: list[list[tuple[int, int, str]]]) -> np.ndarray:
    y = np.zeros(len(t.start), np.int8)
    for a, gold in zip(at.tolist(), golds):
        for x, z, k in gold:
            i, j = np.searchsorted(t.start, a + x), np.searchsorted(t.start, a + z)
            y[i:j] = KIND[k]
    return y


def _batch(t: Tokens, docs: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of each place, real places, sizes) of some texts side by side."""
    width = int(size[docs].max())
    place = np.arange(width)[None, :]
    real = place < size[docs][:, None]
    return np.where(real, first[docs][:, None] + place, first[docs][:, None]), real, size[docs]


def train(texts: int, passes: int, seed: int = 3, vocabulary: str = VOCABULARY, made: list | None = None) -> Field:
    """All potentials of the field by gradient ascent of the loopy likelihood (AdaGrad, small L2), deterministic.

    The expectations come from the same messages that inference passes, so the
    weights of skips are learned with those of tokens and neighbours.
    """
    made = made or labelled(texts, seed)
    made = sorted(made, key=lambda x: len(x[0]))
    _, at, t = tokenize([x for x, _ in made], vocabulary)
    y = gold_labels(at, t, [g for _, g in made])
    k, m = len(LABELS), len(t.start)
    inner = np.flatnonzero(~t.bound)
    docs, first, size = np.unique(t.doc[inner], return_index=True, return_counts=True)
    first = inner[first]
    unary, pair, skip = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k), np.float32), np.zeros((SKIPS, k, k), np.float32)
    su, sp, ss = np.full(unary.shape, 1e-6, np.float32), np.full((k, k), 1e-6), np.full(skip.shape, 1e-6)
    rng = np.random.default_rng(seed)
    groups = [np.arange(a, min(a + 128, len(docs))) for a in range(0, len(docs), 128)]
    eye = np.eye(k, dtype=np.float32)
    often = np.bincount(t.feats.ravel(), minlength=1 << BITS) >= LEAST_SEEN
    where = np.full(m, -1)
    for turn in range(passes):
        rate = 0.5 if turn < passes - 1 else 0.2
        for b in rng.permutation(len(groups)):
            idx, real, sizes = _batch(t, groups[b], first, size)
            flat = idx[real]
            where[flat] = np.arange(len(flat))
            feats = t.feats[:, flat]
            u = np.zeros((*idx.shape, k), np.float32)
            own = scores(Field(unary, pair, skip), feats)
            u[real] = own
            shut = np.zeros(len(idx), bool)
            right = flat[t.skip[flat] >= 0]
            left = t.skip[right]
            kinds = skip_kind(t, right)
            l, r = where[left], where[right]
            extra = np.zeros_like(own)
            ahead = behind = np.zeros((len(l), k), np.float32)
            table = np.exp(skip)[kinds]
            for turn2 in range(ROUNDS if len(l) else 1):
                node, fore, back, e = chain(u, pair, shut, shut, sizes)
                if turn2 + 1 < ROUNDS and len(l):
                    ahead, behind = messages(node[real], l, r, table, ahead, behind)
                    extra[:] = 0
                    np.add.at(extra, r, ahead)
                    np.add.at(extra, l, behind)
                    u[real] = own + extra
            belief = node[real]
            g = eye[y[flat]] - belief
            both = fore[:, :-1, :, None] * np.exp(pair - pair.max()) * (e[:, 1:] * back[:, 1:])[:, :, None, :]
            both = both[real[:, 1:]]
            both /= np.maximum(both.sum((1, 2), keepdims=True), 1e-30)
            gp = np.zeros((k, k))
            ya, yb = y[idx[:, :-1]][real[:, 1:]], y[idx[:, 1:]][real[:, 1:]]
            np.add.at(gp, (ya, yb), 1.0)
            gp -= both.sum(0)
            # each text begins and ends beside label O
            ends = idx[np.arange(len(idx)), sizes - 1]
            np.add.at(gp, (0, y[idx[:, 0]]), 1.0)
            np.add.at(gp, (y[ends], 0), 1.0)
            gp[0] -= belief[where[idx[:, 0]]].sum(0)
            gp[:, 0] -= belief[where[ends]].sum(0)
            if len(l):
                out, into = belief[l] * np.exp(-behind), belief[r] * np.exp(-ahead)
                joint = out[:, :, None] * table * into[:, None, :]
                joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)
                gs = np.zeros_like(skip)
                np.add.at(gs, (kinds, y[left], y[right]), 1.0)
                np.add.at(gs, kinds, -joint)
                gs -= 0.05 * skip
                ss += gs**2
                skip += (0.15 * gs / np.sqrt(ss)).astype(np.float32)
            number = feats.ravel()
            gu = np.stack([np.bincount(number, np.tile(g[:, c], len(feats)), 1 << BITS) for c in range(k)], 1).astype(np.float32)
            on = np.flatnonzero((np.bincount(number, minlength=1 << BITS) > 0) & often)
            gu = gu[on] - 2e-3 * unary[on]
            su[on] += gu**2
            unary[on] += rate * 0.3 * gu / np.sqrt(su[on])
            gp -= 0.01 * pair
            sp += gp**2
            pair += (0.1 * gp / np.sqrt(sp)).astype(np.float32)
    return Field(unary, pair, skip)


WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: texts and passes behind the file
MADE = dict(texts=60_000, passes=3)
_held: list[Field] = []


def save(field: Field, path: Path = WEIGHTS) -> None:
    """Weights of features in steps of one 127th of the largest."""
    step = float(np.abs(field.unary).max()) / 127
    np.savez_compressed(path, bits=BITS, step=step, unary=np.round(field.unary / step).astype(np.int8), pair=field.pair, skip=field.skip)


def weights(path: Path = WEIGHTS) -> Field:
    """The field trained by ``python -m strandloom.llm.pii_training``; it is read once a process."""
    if not _held:
        with np.load(path) as f:
            if int(f["bits"]) != BITS:
                raise ValueError("the weights belong to another number of buckets")
            _held.append(Field(f["unary"].astype(np.float32) * np.float32(f["step"]), f["pair"], f["skip"]))
    return _held[0]


if __name__ == "__main__":
    save(train(**MADE))
