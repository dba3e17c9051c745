"""Whole patterns that training never sees."""
HELD_OUT = r"""Could {N} sign the lease tonight?
The choir is led by {N} these days.
Yesterday {N} wrote that the bus had been late.
We owe {N} a dinner.
Dr. {F} moved the appointment.
Mr. {F} has not replied.
Nobody but {N} knows the code.
Guests of honour: {N} and {N}.
Editor: {N}
with kind regards from {N}
Hello Mrs {F},
{N}, the caretaker, found the cat.
Warm regards,\n{N}\n{P}
Please send the cheque to {A}, {T}.
The bakery moved to {A} last autumn.
Visit us at {A}, {T}!
Shipping address\n{N}\n{A}\n{T}
Our switchboard answers on {P} until noon.
If nobody opens, try {P}.
Mobile number: {P}
Questions? {E} helps.
Applications should reach {E} by May.
Contact us via {E} or {P}.
Register with {L} {I} at the counter.
Your {L}: {I}
She lost her card ({L} {I}).
Die Leitung hat {N}.
Frau {F} kommt etwas später.
Fragen bitte an {E} richten.
Zu erreichen unter {P}.
Das Büro ist in der Nähe: {A}, {T}.
Le concert est dirigé par {N}.
Mme {F} nous rejoint lundi.
Envoyez votre réponse à {E}.
Son bureau : {A}, {T}
{"contact": "{N}", "tel": "{P}"}
client: {N}; mail: {E}; tel: {P}""".split("\n")
HELD_OUT_PLAIN = r"""The ferry was {w} for {d} hours near {T}.
Figure {d} shows {w} {w} over {d} {w}.
Chapter {d}: {W} {w} and {w}
Item {K}{d4} costs {d} euros.
Between {d} and {d} {w} were {w} during the {w}.
Only {d} of {d} {w} had {w} by then.
The {S} {s} gave {d}.{d2}.
Its {w} {w} is {w} but the {w} is not.
Es waren {d} {D} in der {D}.
Il y avait {d} {w} dans le {w}.
Levels of {g} were {w} at {d} hours.
{g} and {g} did not differ.
Warranty number {d3}-{d4}-{d3}
Please {w} the {w} before the {w}.
{W} {w} {w}: {d} {w}, {d} {w}""".split("\n")
