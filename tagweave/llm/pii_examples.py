"""The small labelled table from which the tagger of personal information is trained.

The sentences are of everyday kinds (letters, contracts, news, filings, minutes, forms) in English,
German, French and Spanish and were written for this purpose, from no corpus. A sentence is a pattern
of slots and alternatives; slots of personal information give labelled spans, all other slots and the
text around them are unlabelled. Names are well-known ones or random syllables, in even shares, so that
the tagger learns shapes and neighbours and not only lists.
"""

from __future__ import annotations

import random
import re
import unicodedata

# Slots: N name, C name in capitals, L surname first, S surname (after a title), T telephone, E e-mail
# address, I identity number, A address by language; lower-case slots are no personal information:
# t title, d date, p place, z postcode, o company, b public body, c place in a series of reports, x number, m sum, r a name that is
# hidden or only initials, q another value that is hidden, k file or invoice number, u heading in
# capitals, g thing or product, v surname alone. [[a|b]] is one of its parts.
PATTERNS = {
    "en": """
Dear {t} {S}, [[thank you for|I refer to|we have received]] your [[letter|email|complaint]] of {d}.
[[Please|Kindly]] [[contact|call|ask for|write to]] {N} [[on|at]] {T} or [[at|via]] {E}.
[[Our client|My brother|The buyer|The patient|The deceased]], {N}, [[lives|lived|has an office|was found]] at {A}, {p} {z}.
{N} ({E}) [[joined|left|advises]] {o} in {p} [[as sales manager|last year|after a dispute]].
This [[agreement|lease|deed|loan]] is made [[on {d} |]]between {N} of {A}, {p}, and [[{o}|{N}]].
The [[tenant|borrower|employee]] shall pay {m} to [[{N}|{o}|{r}]] on the first day of each month.
[[SSN|Social Security Number|NI number|National ID|Passport No.|Tax ID|TIN|Insurance no.|Personal number]][[:|]] {I}
[[Her|His|My|The applicant's]] [[social security number|passport number|national insurance number|tax number|identity card number|Medicare number]] [[is|was|reads]] {I}.
{t} {S} and {t} {S} told [[reporters|the panel|shareholders]] that talks in {p} had failed.
[[According to|In the words of|As reported by]] {N}, [[a spokeswoman for {o}|who chairs the board|an engineer]], profits rose by {x} per cent.
Before: {N}, {N} and {N}, [[Judges|Justices|arbitrators]]
BEFORE JUDGE {C}
Judge: {N} [[Clerk|Reporter]]: {N}
{N} [[v|v.|vs.|versus|-v-|and]] {N}
{N} [[v|v.|vs.]] {o}
{o} [[v|v.|vs.]] {N}
{L} [[v|v.|vs.]] {L}
{C} [[v|v.|-v-]] {C}
{L}, [[claimant|plaintiff|appellant|petitioner]], and {o}, [[defendant|respondent]].
[[Attorney|Counsel|Solicitor]] for the [[plaintiff|defendant|appellant]][[:|,]] {N}, {A}, {p}, {T}.
Signed [[by {N} |]]in the presence of {N}[[ and {N}|]].
[[Emergency contact|Next of kin|Account holder]]: {N}, phone {T}
[[Attendees|Present|Apologies|Witnesses]]: {N}, {N}, {N} and {N}.
[[From|To|Cc|Reply to]]: {N} <{E}>
Patient: {L}; born {d}; insurance no. {I}; tel. {T}
My [[mobile|number|office line]] is {T}; [[my sister|our agent]] {N} [[can be reached at|answers]] {T}.
I, {N}, born [[on {d} |]]in {p}, declare that my tax number is {I}.
[[Deliver|Send|Bring]] the [[parcel|goods|keys]] to {A} before {d}.
The [[flat|house|shop|warehouse]] at {A} was [[sold|let|given]] to {N} for {m}.
[[The witness|The victim|The nurse|The driver|The accountant|A neighbour]] {N} [[said|stated|recalled|denied|conceded]] that {N} [[left|sold|entered]] the house at {A}[[ in {p}|]].
{t} {S} asked {t} {S} whether the contract with {o} was valid.
[[Judge|Justice|Inspector|Doctor|Senator]] {S} [[agreed|dissented|wrote the opinion|adjourned the hearing]].
{b} in {p} [[dismissed the appeal|granted leave|heard the case]] in case {k}.
Invoice [[no. |]]{k} dated {d} for {m} is [[overdue|paid|disputed]].
{u}
Clause {x} of the [[Agreement|Lease|Act]] provides that {g} remain the property of {o}.
[[The witness|The driver|Officer|{t}]] {r} did not recall the [[number|address]] {q}.
{r} and {N} were [[married|colleagues|partners]] until {d}.
[[Contact|Details]]: {q}; {q}; {N}
The [[Board|Court|Tribunal|Committee]] finds that {g} were [[defective|delivered late|never ordered]]; see [[Exhibit|Annex|Schedule]] {x}.
[[On|In|Since]] {d} the [[Claimant|Buyer|Company|Minister]] [[served notice|asked for payment|withdrew the offer]].
The University of {p} and {o} signed a [[licence|lease|treaty]] with {b}.
{v} [[denied|accepted]] this, but {N} insisted that {g} had been paid for.
{o} is registered in {p} under number {x} and trades as {o}.
Only {N} and {N} [[knew|signed|travelled]]; {t} {S} stayed in {p}.
It was {N} who [[called|phoned|dialled]] {T} and then wrote to {E}.
[[He|She]] was born in {p} and holds passport {I}, [[valid until {d}|a copy of which is attached]].
[[Payments|Questions|Complaints]] go to {E}[[ or to {A}|, not to {o}]].
[[The expert|Professor]] {N} of the University of {p} [[examined|measured|valued]] {g}.
Fax {T}, switchboard {T}, [[orders|claims]] {E}
[[Section|Article|Rule|Regulation]] {x} [[requires|provides|permits]] that [[the court|the parties|each owner]] [[consider|give|keep]] {g}.
[[Where|Although|Because|If|While]] the [[defendant|insurer|seller]] [[relies on|refers to|disputes]] {g}, [[the burden|the risk|the cost]] [[passes to|rests on|stays with]] the other [[party|side]].
See {o} v {o}, {c}, at {x}.
See {v} v {o}, {c}; [[cf.|compare]] paragraph {x}.
[[As held in|See also|Contrast]] {c} [[and|or]] {c}, where the same point was left open.
{b}, {p} [[Case|Claim|Docket]] No. {k} [[Order|Decision|Opinion]] of {d}
{C} [[and|,]] {C} [[Heard|Argued|Decided|Filed|Published|Delivered]] [[on |]]{d}
Costs of {m} were awarded. [[The appeal is allowed.|Leave is refused.|The order stands.]] Page {x} of {x}
[[Name|Full name]]: {N} [[Address|Residence]]: {A} [[Phone|Tel]]: {T} [[E-mail|Mail]]: {E} ID: {I}
{N}, {A}, {z} {p}
[[Mother|Father|Spouse|Employer]]: {N}, {A}; {E}
[[|Parties: |Between: ]]{L} ([[plaintiff|tenant|heir|claimant]])[[,|;]] {L} ([[defendant|guarantor]])
[[On|By|Since|Before]] {d}[[,|]] {N} [[paid|replied|had moved|resigned|wrote]], and {t} {S} [[agreed|protested]].
{N}, [[formerly of {p}|aged {x}|a carpenter]], [[appeared|testified|walked]] [[in person|before the panel|home]].
The letter was [[addressed|forwarded|returned]] to {t} {S} at {A}, {p}.
The [[Managing Director|Chief Executive|Secretary General|Vice President]] of {o}, {N}, resigned [[in|on]] {d}.
[[Monday|Tuesday|Friday|Sunday]] [[Morning|Market|Bank]] Holdings and {o} opened in New {p} and Port {p}.
""",
    "de": """
Sehr geehrter Herr {S}, [[vielen Dank für|wir beziehen uns auf]] Ihr Schreiben vom {d}.
Sehr geehrte Frau {S}, [[Ihr Antrag|Ihre Kündigung|Ihre Beschwerde]] ist am {d} eingegangen.
Bitte [[wenden Sie sich an|rufen Sie]] {N}[[, Telefon| unter]] {T} oder [[per E-Mail an|schreiben Sie an]] {E}.
[[Unser Mandant|Die Mieterin|Der Patient|Meine Schwester]] {N}, [[wohnhaft|wohnhaft in der|wohnt]] {A}, {z} {p}.
Zwischen {N}, {A}, {p}, und [[{o}|{N}]] wird folgender [[Mietvertrag|Kaufvertrag|Arbeitsvertrag]] geschlossen.
{N} ([[{E}|Vorstand|Geschäftsführerin]]) [[wechselte|kam]] im {d} zu {o} nach {p}.
[[Steuer-ID|Steuernummer|Personalausweis-Nr.|Reisepass-Nr.|Versicherungsnummer|Rentenversicherungsnummer|Sozialversicherungsnummer]][[:|]] {I}
[[Seine|Ihre]] [[Ausweisnummer|Passnummer|Steueridentifikationsnummer|Versichertennummer]] [[lautet|ist]] {I}.
Frau {S} und Herr {S} [[erklärten|teilten mit|bestritten]], dass die Gespräche in {p} gescheitert seien.
[[Nach Angaben von|Laut|Wie]] {N}[[, Sprecherin der {o},|, Ingenieur bei der {o},]] [[stieg|sank]] der Umsatz um {x} Prozent.
[[Vorsitzender Richter|Vorsitzende Richterin|Berichterstatter|Protokollführerin]][[:|]] {N}
[[Richter|Richterin|Rechtsanwalt|Rechtsanwältin|Notar|Staatsanwältin|Zeuge|Zeugin]] {N} [[erschien nicht|wurde gehört|verlas die Urkunde|stellte den Antrag]].
{N} [[gegen|./.|und]] {N}
{N} [[gegen|./.]] {o}
{o} [[gegen|./.]] {N}
{L} [[gegen|./.]] {L}
{C} – [[Kläger|Antragstellerin|Beschwerdeführer]] –
{L} – [[Beklagte|Schuldner|Klägerin]] – [[Verfahrensbevollmächtigter|vertreten durch]]: [[Rechtsanwalt|RA|RAin]] {N}
In Sachen {N}, {A}, {z} {p}, [[Kläger|Antragsteller|Gläubigerin]], [[gegen|wider]] {N}, {A}, {z} {p}
Unterschrieben [[von {N} |]]in Gegenwart von {N}[[ und {N}|]].
[[Ansprechpartner|Kontoinhaber|Notfallkontakt|Bearbeiter]]: {N}, [[Tel.|Telefon|Mobil]] {T}
[[Anwesend|Teilnehmer|Entschuldigt]]: {N}, {N}, {N} und {N}.
[[Von|An|Kopie]]: {N} <{E}>
Patient: {L}, geb. {d}, Vers.-Nr. {I}, Tel. {T}
[[Meine Nummer ist|Sie erreichen mich unter|Rückruf erbeten unter]] {T}; [[mein Kollege|unsere Beraterin]] {N} hat die {T}.
Ich, {N}, geboren am {d} in {p}, [[versichere|erkläre]], dass meine Steuernummer {I} lautet.
Die [[Wohnung|Werkstatt|Praxis]] [[{A}|in der {A}]] wurde an {N} für {m} [[verkauft|vermietet|übergeben]].
Der [[Fahrer|Nachbar|Pfleger|Buchhalter|Gutachter|Kläger|Beklagte]] {N} [[gab an|sagte aus|räumte ein|vermutete]], dass {N} das Haus {A}[[ in {p}|]] verlassen habe.
Dr. {S} [[fragte|bat]] Herrn {S}, ob der Vertrag mit der {o} wirksam sei.
{b} in {p} [[wies die Berufung zurück|ließ die Beschwerde zu]], Az. {k}.
Rechnung [[Nr. |]]{k} vom {d} über {m} ist [[offen|bezahlt|streitig]].
{u}
Nach § {x} Abs. {x} [[des Gesetzes|BGB|ZPO|der Satzung]] [[haftet der Verkäufer|trägt die Versicherung die Kosten|ist die Klage unzulässig]].
[[Der Zeuge|Die Zeugin|Herr|Frau]] {r} erinnerte sich nicht an die [[Nummer|Anschrift]] {q}.
{r} und {N} waren bis {d} [[verheiratet|Kollegen|Gesellschafter]].
[[Kontakt|Angaben]]: {q}; {q}; {N}
[[Das Gericht|Der Senat|Die Kammer|Der Ausschuss]] stellt fest, dass {g} [[mangelhaft|verspätet geliefert|nie bestellt]] waren; vgl. [[Anlage|Blatt|Beleg]] {x}.
Am {d} hat [[der Käufer|die Gesellschaft|das Ministerium|die Behörde]] [[Widerspruch eingelegt|die Frist versäumt|Zahlung verlangt]].
Die Universität {p} und die {o} schlossen einen [[Vertrag|Vergleich]] mit {b}.
{v} [[bestritt das|stimmte zu]], doch {N} bestand darauf, dass {g} bezahlt seien.
Die {o} ist im Handelsregister des [[Amtsgerichts|Registergerichts]] {p} unter HRB {x} eingetragen.
Nur {N} und {N} [[wussten davon|unterschrieben|reisten ab]]; Frau {S} blieb in {p}.
Es war {N}, [[der|die]] {T} [[anrief|wählte]] und danach an {E} schrieb.
[[Beschwerden|Fragen|Zahlungen]] richten Sie an {E}[[ oder an die Anschrift {A}|, nicht an die {o}]].
[[Die Sachverständige|Professor|Prof. Dr.]] {N} von der Universität {p} [[untersuchte|vermaß]] {g}.
Fax {T}, Zentrale {T}, [[Bestellungen|Schäden]] {E}
[[Die Revision|Die Beschwerde|Der Antrag|Die Berufung]] [[ist unbegründet|hat Erfolg|bleibt ohne Erfolg]]. Die [[Kosten des Verfahrens|Gerichtskosten]] trägt die [[Klägerin|Beklagte]].
[[Wenn|Weil|Obwohl|Sofern]] der [[Verkäufer|Versicherer|Vermieter]] sich auf {g} [[beruft|verlässt]], [[geht die Gefahr über|trifft ihn die Beweislast]].
Vgl. [[BGH|OLG {p}|BAG|BVerfG]], [[Urteil|Beschluss]] vom {d} – {k} –, {c}, {x} Rn. {x}.
[[Die Zulässigkeit|Der Streitwert|Die Zuständigkeit]] ist [[von Amts wegen|von Rechts wegen|nach freiem Ermessen]] [[zu prüfen|festzusetzen]] ({c}).
{b} {p}, [[Urteil|Beschluss]] vom {d}, Az. {k}
[[Am|Seit dem|Vor dem]] {d} [[zahlte|schrieb|kündigte]] {N}, [[worauf|als]] {N} [[antwortete|widersprach]].
Ein Betrag in Höhe von {m} ist von Bedeutung für die Frage von Schuld und Haftung; {g} sind von Beginn an Sache der Partei.
Seite {x} von {x} [[Urteil|Beschluss|Protokoll]] [[vom|v.]] {d} [[Geschäftszeichen|Az.]]: {k}
[[Name|Vor- und Nachname]]: {N} [[Anschrift|Adresse]]: {A} Telefon: {T} E-Mail: {E} Ausweis: {I}
{N}, {A}, {z} {p}
[[Mutter|Vater|Ehefrau|Arbeitgeber]]: {N}, {A}; {E}
Der Brief [[ging an|war gerichtet an]] Herrn {S}, {A}, {z} {p}.
Die Vorstandsvorsitzende der {o}, {N}, trat am {d} zurück.
Der Pass {I} [[von|des]] {N} wurde [[eingezogen|kopiert|verlängert]].
[[Die Gemeinde|Der Landkreis|Die Stadt]] {p} [[vermietet|saniert]] {g} am [[Alten Markt|Großen Teich|Neuen Tor]].
""",
    "fr": """
[[Monsieur|Madame]] {S}, [[nous accusons réception de|je vous remercie pour]] votre [[lettre|courrier|demande]] du {d}.
[[Merci de|Veuillez]] [[contacter|appeler|joindre]] {N} au {T} ou [[par courriel à|à l'adresse]] {E}.
[[Notre client|La locataire|Le patient|Mon frère]], {N}, [[habite|demeurant|réside au|domicilié]] {A}, {z} {p}.
Entre [[les soussignés |]]{N}, {A}, à {p}, et [[{o}|la société {o}|{N}]], il est convenu ce qui suit.
{N} ([[{E}|directrice]]) a [[rejoint|quitté]] la société {o} à {p}.
[[Numéro de sécurité sociale|N° de passeport|NIR|Carte d'identité n°|Numéro fiscal|Passeport]] [[: |]]{I}
[[Son|Votre]] [[numéro fiscal|numéro de sécurité sociale|numéro de passeport]] est le {I}.
{t} {S} et {t} {S} ont [[déclaré|confié|indiqué]] que les négociations de {p} avaient échoué.
[[Selon|D'après|Pour]] {N}, [[porte-parole de {o}|qui préside le conseil|ingénieur]], le bénéfice a progressé de {x} %.
[[Président|Présidente|Rapporteur|Greffière|Avocat général]] : {N}
[[Maître|Me|Le juge|L'avocate|Le notaire|L'expert|La conseillère|Le procureur]] {N} [[a plaidé|a été entendu|a rendu son rapport|ne s'est pas présenté]].
{N} [[c/|contre|c.|et]] {N}
{N} [[c/|contre]] {o}
{o} [[c/|contre]] {N}
{L} [[c/|contre]] {L}
{C} [[c/|contre]] {C}
{N}, né le {d} à {p}, [[appelant|requérante|demandeur]], [[assisté de|représenté par]] Me {N}, et {o}, [[intimée|défenderesse]]
Signé [[par {N} |]]en présence de {N}[[ et de {N}|]].
[[Personne à prévenir|Titulaire du compte|Contact]] : {N}, [[tél.|téléphone|portable]] {T}
[[Présents|Excusés|Participants]] : {N}, {N}, {N} et {N}.
[[De|À|Copie]] : {N} <{E}>
Patient : {L} ; né le {d} ; assuré n° {I} ; tél. {T}
[[Mon numéro est le|Je suis joignable au|Rappelez-moi au]] {T} ; [[ma collègue|mon associé]] {N} répond au {T}.
Je soussigné {N}, né le {d} à {p}, déclare que mon numéro fiscal est {I}.
[[L'appartement|Le local|La maison]] [[du|situé|sis]] {A} a été [[vendu|loué|remis]] à {N} pour {m}.
[[Le témoin|L'infirmière|Le chauffeur|La comptable|Un voisin|La victime]] {N} a [[affirmé|reconnu|précisé|nié]] que {N} avait quitté la maison du {A}[[ à {p}|]].
{t} {S} a demandé à {t} {S} si le contrat avec {o} était valable.
{b} de {p} a [[rejeté l'appel|accueilli la demande]] dans l'affaire {k}.
La facture [[n° |]]{k} du {d}, d'un montant de {m}, est [[impayée|réglée|contestée]].
{u}
Aux termes de l'article {x} du [[code civil|contrat|règlement]], [[le vendeur|l'assureur|le bailleur]] [[garantit|doit|supporte]] {g}.
[[Le témoin|La gérante|M.|Mme]] {r} ne se souvenait pas [[du numéro|de l'adresse]] {q}.
{r} et {N} étaient [[mariés|associés|collègues]] jusqu'au {d}.
[[Contact|Coordonnées]] : {q} ; {q} ; {N}
[[La cour|Le tribunal|Le comité|La commission]] constate que {g} étaient [[défectueux|livrés en retard]] ; voir [[annexe|pièce]] {x}.
Le {d}, [[l'acheteur|la compagnie|le ministre|l'employeur]] a [[formé un recours|demandé le paiement|résilié le bail]].
L'université de {p} et {o} ont signé [[un bail|une convention]] avec {b}.
{v} l'a [[contesté|admis]], mais {N} a maintenu que {g} étaient payés.
La société {o} est immatriculée au registre du commerce de {p} sous le numéro {x}.
Seuls {N} et {N} [[savaient|ont signé|sont partis]] ; {t} {S} est restée à {p}.
C'est {N} qui a [[appelé|composé]] le {T} puis écrit à {E}.
[[Les réclamations|Les paiements|Les questions]] sont à adresser à {E}[[ ou au {A}|, non à {o}]].
[[L'experte|Le professeur]] {N}, de l'université de {p}, a [[examiné|mesuré]] {g}.
Télécopie {T}, standard {T}, [[commandes|sinistres]] {E}
[[Lorsque|Si|Puisque|Bien que]] [[le vendeur|l'assureur|le transporteur]] [[invoque|conteste]] {g}, [[la charge de la preuve|le risque]] lui incombe.
[[Cass.|CA {p}|CE]], {d}, n° {k}, {c} ; [[cf.|comp.]] point {x}.
{b} de {p}, [[jugement|arrêt|ordonnance]] du {d}, n° {k}
[[Le|Depuis le|Avant le]] {d}[[,|]] {N} a [[payé|répondu|démissionné]], et {N} a [[accepté|protesté]].
[[Le pourvoi est rejeté.|L'appel est recevable.|Les dépens sont réservés.]] Page {x} sur {x}
[[Nom|Nom et prénom]] : {N} Adresse : {A} Téléphone : {T} Courriel : {E} Pièce : {I}
{N}, {A}, {z} {p}
[[Mère|Père|Épouse|Employeur]] : {N}, {A} ; {E}
Le pli a été [[adressé|retourné|remis]] à {t} {S}, {A}, {z} {p}.
La directrice générale de {o}, {N}, a démissionné le {d}.
Le passeport {I} de {N} a été [[saisi|renouvelé|photocopié]].
[[La commune|Le département|La ville]] de {p} [[loue|rénove]] {g} près du [[Grand Palais|Pont Neuf|Vieux Port]].
""",
    "es": """
Estimado {t} {S}: [[gracias por|hemos recibido]] su [[carta|correo|reclamación]] de {d}.
[[Póngase en contacto con|Llame a|Pregunte por|Escriba a]] {N} [[en el|al]] {T} o [[por correo a|en]] {E}.
[[Nuestro cliente|La inquilina|El paciente|Mi hermano]], {N}, [[vive en|reside en|con domicilio en]] {A}, {z} {p}.
Entre {N}, [[de|con domicilio en]] {A}, {p}, y [[{o}|{N}]] se acuerda lo siguiente.
{N} ([[{E}|directora]]) [[dejó|se incorporó a]] {o} en {p}.
[[DNI|NIF|NIE|Pasaporte n.º|Número de la Seguridad Social|Documento]][[:|]] {I}
[[Su|El]] [[número de pasaporte|número de afiliación|NIF|DNI]] es {I}.
{t} {S} y {t} {S} [[declararon|afirmaron|explicaron]] que las conversaciones de {p} habían fracasado.
[[Según|A juicio de|Como indicó]] {N}, [[portavoz de {o}|que preside el consejo|ingeniera]], el beneficio creció un {x} %.
[[Presidente|Ponente|Secretaria|Magistrada]]: {N}
[[El juez|La letrada|El abogado|La fiscal|El notario|El procurador|La perita|El magistrado]] {N} [[compareció|no asistió|emitió su informe|presentó escrito]].
{N} [[contra|c.|y]] {N}
{N} contra {o}
{o} contra {N}
{L} contra {L}
{C} contra {C}
{N}, [[demandante|recurrente|apelante]], [[representado por|asistida por]] [[el procurador|la letrada]] {N}, y {o}, [[demandada|recurrida]]
Firmado [[por {N} |]]en presencia de {N}[[ y de {N}|]].
[[Titular de la cuenta|Persona de contacto|En caso de urgencia]]: {N}, [[tel.|teléfono|móvil]] {T}
[[Asistentes|Presentes|Excusados]]: {N}, {N}, {N} y {N}.
[[De|Para|Copia]]: {N} <{E}>
Paciente: {L}; nacido el {d}; afiliación {I}; tel. {T}
[[Mi número es el|Puede localizarme en el|Llámeme al]] {T}; [[mi socia|nuestro agente]] {N} atiende el {T}.
Yo, {N}, nacido el {d} en {p}, declaro que mi NIF es {I}.
[[El piso|El local|La vivienda]] [[de|sita en|situado en]] {A} fue [[vendido|alquilado|entregado]] a {N} por {m}.
[[El testigo|La enfermera|El conductor|La contable|Un vecino|La víctima]] {N} [[afirmó|reconoció|negó|recordó]] que {N} salió de la casa de {A}[[ en {p}|]].
{t} {S} preguntó a {t} {S} si el contrato con {o} era válido.
{b} de {p} [[desestimó el recurso|admitió la demanda]] en el asunto {k}.
La factura [[n.º |]]{k} de {d}, por {m}, está [[pendiente|pagada|impugnada]].
{u}
Conforme al artículo {x} [[del Código Civil|del contrato|de la Ley]], [[el vendedor|la aseguradora|el arrendador]] [[responde de|debe]] {g}.
[[El testigo|La gerente|D.|Sra.]] {r} no recordaba [[el número|la dirección]] {q}.
{r} y {N} fueron [[socios|esposos|compañeros]] hasta el {d}.
[[Contacto|Datos]]: {q}; {q}; {N}
[[La Sala|El tribunal|El comité|La comisión]] considera que {g} eran [[defectuosos|de otro|antiguos]]; véase [[anexo|documento|folio]] {x}.
El {d}, [[el comprador|la compañía|el ministerio|la empresa]] [[interpuso recurso|exigió el pago|resolvió el contrato]].
La Universidad de {p} y {o} firmaron [[un convenio|un acuerdo]] con {b}.
{v} lo [[negó|admitió]], pero {N} insistió en que {g} estaban pagados.
La sociedad {o} consta en el Registro Mercantil de {p}, tomo {x}, hoja {x}.
Solo {N} y {N} [[lo sabían|firmaron|viajaron]]; {t} {S} se quedó en {p}.
[[Quien llamó al {T} fue {N}|Fue {N} quien marcó el {T}]] y después escribió a {E}.
[[Las reclamaciones|Los pagos|Las preguntas]] se dirigen a {E}[[ o a {A}|, no a {o}]].
[[El perito|La profesora|El catedrático]] {N}, de la Universidad de {p}, [[examinó|midió]] {g}.
Fax {T}, centralita {T}, [[pedidos|siniestros]] {E}
[[Cuando|Si|Aunque|Puesto que]] [[el vendedor|la aseguradora|el transportista]] [[alega|discute]] {g}, [[la carga de la prueba|el riesgo]] le corresponde.
[[STS|SAP {p}|STC]] {x}/{x}, de {d}, [[rec.|FJ]] {k}, {c}; [[cf.|véase]] apartado {x}.
{b} de {p}, [[sentencia|auto]] de {d}, [[autos|recurso]] {k}
[[El|Desde el|Antes del]] {d}[[,|]] {N} [[pagó|respondió|dimitió]], y {N} [[aceptó|protestó]].
[[Se desestima el recurso.|Se admite la demanda.|Sin imposición de costas.]] Página {x} de {x}
[[Nombre|Nombre y apellidos]]: {N} Dirección: {A} Teléfono: {T} Correo: {E} DNI: {I}
{N}, {A}, {z} {p}
[[Madre|Padre|Cónyuge|Empleador]]: {N}, {A}; {E}
La carta fue [[dirigida|devuelta|entregada]] a {t} {S}, {A}, {z} {p}.
La consejera delegada de {o}, {N}, dimitió el {d}.
El pasaporte {I} de {N} fue [[retenido|renovado|fotocopiado]].
[[El ayuntamiento|La diputación|La ciudad]] de {p} [[alquila|restaura]] {g} junto a la [[Puerta Grande|Torre Nueva|Plaza Mayor]].
""",
}
TITLES = {
    "en": ["Mr", "Mrs", "Ms", "Dr", "Mr.", "Mrs.", "Ms.", "Dr.", "Miss", "Prof.", "Professor", "Judge", "Sir", "Captain"],
    "de": ["Herr", "Frau", "Herrn", "Herr Dr.", "Frau Dr.", "RA", "RAin", "Dr.", "Prof.", "Rechtsanwalt", "Richterin"],
    "fr": ["M.", "Mme", "Monsieur", "Madame", "Me", "Maître", "Dr", "Mlle", "Mademoiselle", "Docteur"],
    "es": ["Sr.", "Sra.", "señor", "señora", "D.", "D.ª", "Dña.", "don", "doña", "Don", "Doña", "Dr.", "Dra.", "Señora"],
}
# Well-known names and words, plainly as they are.
GIVEN = {
    "en": "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Donald Sandra Steven Ashley Paul Kimberly Andrew Emily Joshua Donna Kenneth Michelle Kevin Carol Brian Amanda George Dorothy Edward Melissa Ronald Deborah Timothy Stephanie Priya Aisha Wei Olivia Oliver Harry Chloe".split(),
    "de": "Peter Ursula Michael Monika Wolfgang Petra Thomas Elisabeth Klaus Sabine Manfred Renate Jürgen Helga Günter Karin Stefan Brigitte Andreas Ingrid Frank Erika Bernd Andrea Uwe Gisela Dieter Claudia Werner Susanne Heinz Gabriele Matthias Christa Hans Anja Jörg Silke Karl Heike Lukas Leon Mia Lena Sophie Emma Björn Käthe Mehmet Ayşe Anneliese Torsten Ulrike Dirk".split(),
    "fr": "Jean Marie Pierre Jeanne Michel Françoise André Monique Philippe Catherine Alain Nathalie Bernard Isabelle Jacques Jacqueline Daniel Sylvie Christophe Martine Patrick Anne Nicolas Hélène Laurent Nicole Éric Sophie Julien Céline Antoine Élodie Mathieu Camille Guillaume Aurélie Hugo Chloé Léa Manon Karim Fatima Benoît Geneviève Yves Odile Marcel Lucie Thierry Agnès".split(),
    "es": "Antonio Carmen José María Manuel Josefa Francisco Isabel Juan Dolores Pedro Pilar Jesús Teresa Luis Ana Carlos Laura Miguel Cristina Javier Marta Rafael Lucía Fernando Elena Jorge Rosa Alberto Raquel Sergio Sara Pablo Paula Andrés Rocío Álvaro Beatriz Diego Inés Iván Nuria Rubén Sofía Joaquín Concepción Ramón Mercedes Gonzalo Amparo".split(),
}
SURNAMES = {
    "en": "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Walker Hall Young King Wright Hill Scott Green Baker Adams Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Murphy Cook Rogers Bailey Cooper Ward Patel Khan Singh O'Brien O'Connor McDonald MacLeod Fitzgerald Chen Nguyen Lopez Ali".split(),
    "de": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Werner Krause Lehmann Köhler Maier Kaiser Fuchs Vogel Keller Weiß Jung Hahn Schubert Winkler Roth Beck Lorenz Baumann Franke Albrecht Kowalski Yılmaz Öztürk Nowak Stein Jäger Otto Sommer".split(),
    "fr": "Martin Bernard Dubois Thomas Robert Richard Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia David Bertrand Roux Vincent Fournier Morel Girard André Lefèvre Mercier Dupont Lambert Bonnet François Martinez Legrand Garnier Faure Rousseau Blanc Guérin Muller Henry Roussel Nicolas Perrin Morin Mathieu Clément Gauthier Dumont Lopez Fontaine Chevalier Robin Benali Traoré".split(),
    "es": "García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Ramos Gil Ramírez Serrano Blanco Molina Morales Suárez Ortega Delgado Castro Ortiz Rubio Marín Sanz Núñez Iglesias Medina Garrido Cortés Castillo Santos Lozano Guerrero Cano Prieto Méndez Cruz".split(),
}
MARKS = ["de la ", "du ", "dos ", "von ", "van ", "van der ", "von der ", "de ", "del ", "de los ", "di ", "zu ", "Mac", "Mc", "D'", "O'", "El ", "da "]
PLACES = {
    "en": "London Leeds Bristol York Boston Dallas Denver Seattle Dublin Glasgow Cardiff Oxford Toronto Sydney Brighton Norwich Exeter Chicago Houston Plymouth Salem Madison Springfield Cambridge".split() + ["New York", "Los Angeles", "San Diego", "Hong Kong", "St Albans", "Milton Keynes"],
    "de": "Berlin Hamburg München Köln Frankfurt Stuttgart Dresden Leipzig Bremen Hannover Wien Zürich Bonn Mainz Kiel Münster Augsburg Potsdam Rostock Kassel Graz Linz Basel Erfurt".split() + ["Bad Homburg", "Freiburg im Breisgau", "Halle (Saale)"],
    "fr": "Paris Lyon Marseille Toulouse Nice Nantes Bordeaux Lille Rennes Reims Grenoble Dijon Angers Nîmes Brest Tours Limoges Amiens Metz Besançon Rouen Nancy Genève Bruxelles".split() + ["Le Havre", "Aix-en-Provence", "Saint-Étienne", "La Rochelle"],
    "es": "Madrid Barcelona Valencia Sevilla Zaragoza Málaga Murcia Bilbao Alicante Córdoba Valladolid Vigo Gijón Granada Oviedo Cádiz Burgos Toledo León Segovia Lima Bogotá Salamanca Almería".split() + ["Las Palmas", "San Sebastián", "La Coruña", "Palma de Mallorca"],
}
TOWN_ENDS = {"en": "ford ton ham bury wick mouth field bridge port stead holm by".split(), "de": "burg dorf heim hausen berg stadt feld rode kirchen see hafen bach".split(), "fr": "ville ac court mont ières igny olles ay".split(), "es": "ar illa edo ejo osa era ales uela".split()}
FIRMS = {
    "en": (["Ltd", "Limited", "plc", "LLC", "Inc.", "Corp.", "LLP", "& Sons", "& Co.", "Group", "Foundation"], "Shipping Insurance Steel Foods Motors Textiles Energy Software Logistics Airlines Books Dairy Homes Capital Bank Media Pharma Retail Hotels Telecom Services".split()),
    "de": (["GmbH", "AG", "KG", "e.V.", "GmbH & Co. KG", "SE", "OHG", "eG", "& Partner"], "Logistik Versicherung Stahl Handel Bau Chemie Energie Technik Verlag Brauerei Möbel Transport Maschinenbau Werke Bank".split()),
    "fr": (["SA", "SARL", "S.A.", "SAS", "et Fils", "SCI", "& Cie"], "Assurances Transports Textiles Acier Énergie Éditions Bâtiment Immobilier Hôtels Pharma Banque Vins".split()),
    "es": (["S.A.", "S.L.", "SA", "SL", "e Hijos", "S.Coop.", "S.A.U."], "Seguros Transportes Aceros Textiles Energía Construcciones Editorial Inmobiliaria Hoteles Farma Banco Bodegas".split()),
}
BODIES = {
    "en": ["The High Court", "The Supreme Court", "The County Court", "The District Court", "The Court of Appeal", "The City Council", "The Labour Tribunal", "The Ministry of Health", "The Tax Office", "The Police Department", "{p} Crown Court", "{p} Employment Tribunal", "{p} Airport Authority", "The Housing Authority of {p}", "The University of {p}", "The Court of Appeal of {p}", "The Bank of {p}", "The {p} School Board"],
    "de": ["Das Landgericht", "Das Amtsgericht", "Das Oberlandesgericht", "Das Finanzamt", "Der Bundesgerichtshof", "Das Arbeitsgericht", "Die Stadtverwaltung", "Das Bundesministerium", "Die Staatsanwaltschaft", "Landgericht {p}", "Amtsgericht {p}", "Das Amtsgericht {p}", "Die Hafenbehörde {p}"],
    "fr": ["La cour d'appel", "Le tribunal judiciaire", "Le conseil municipal", "Le tribunal administratif", "La Cour de cassation", "Le ministère de la Santé", "La préfecture", "Le conseil de prud'hommes", "Tribunal de grande instance", "Cour d'appel", "Le tribunal de commerce", "La chambre sociale"],
    "es": ["El Tribunal Supremo", "La Audiencia Provincial", "El Juzgado de lo Social", "El Ayuntamiento", "El Ministerio de Sanidad", "La Agencia Tributaria", "El Juzgado de Primera Instancia", "La Policía Nacional", "Juzgado de Primera Instancia n.º {x}", "Juzgado de lo Social núm. {x}", "La Sala de lo Civil"],
}
HEADS = {
    "en": "SUPREME COURT OF {p}|IN THE HIGH COURT OF JUSTICE|TERMS AND CONDITIONS|REASONS FOR JUDGMENT|{p} COUNTY COURT|CIVIL DIVISION|ORDER|ANNUAL REPORT OF THE BOARD|MINUTES OF THE MEETING|NOTICE OF APPEAL|COURT OF APPEAL OF {p}",
    "de": "LANDGERICHT {p}|IM NAMEN DES VOLKES|AMTSGERICHT {p}|URTEIL|BESCHLUSS|TATBESTAND UND GRÜNDE|ALLGEMEINE BEDINGUNGEN|OBERLANDESGERICHT {p}|PROTOKOLL DER SITZUNG|VERTRAG",
    "fr": "COUR D'APPEL DE {p}|RÉPUBLIQUE FRANÇAISE|AU NOM DU PEUPLE FRANÇAIS|TRIBUNAL DE {p}|ARRÊT|MOTIFS DE LA DÉCISION|CONDITIONS GÉNÉRALES|PROCÈS-VERBAL|TRIBUNAL DE COMMERCE DE {p}|PAR CES MOTIFS",
    "es": "AUDIENCIA PROVINCIAL DE {p}|EN NOMBRE DEL REY|SENTENCIA|FUNDAMENTOS DE DERECHO|JUZGADO DE LO MERCANTIL DE {p}|CONDICIONES GENERALES|ACTA DE LA REUNIÓN|TRIBUNAL SUPERIOR DE {p}|FALLO|ANTECEDENTES DE HECHO",
}
THINGS = {
    "en": "the goods|the machines|the windows|two engines|the documents|the Christmas orders|the terms of the Sale of Goods Act|the Green Card forms|all repairs|the Board's minutes|good faith and fair dealing|the limitation period|the Annual Accounts",
    "de": "die Waren|die Maschinen|die Fenster|zwei Motoren|die Unterlagen|die Nebenkosten|die Verjährung|Treu und Glauben|die Allgemeinen Geschäftsbedingungen|die Jahresabschlüsse|alle Reparaturen|die Gewährleistung und der Rücktritt",
    "fr": "les marchandises|les machines|les fenêtres|deux moteurs|les documents|les charges|la prescription|la bonne foi|les conditions générales de vente|les comptes annuels|les travaux|la garantie décennale",
    "es": "las mercancías|las máquinas|las ventanas|dos motores|los documentos|los gastos|la prescripción|la buena fe|las condiciones generales|las cuentas anuales|las obras|la garantía y el saneamiento",
}
STREETS = {
    "en": ("Street|Road|Lane|Avenue|Drive|Court|Close|Way|Terrace|Square|Gardens|Place|Crescent|Hill|Walk|Boulevard|Mews|Rise|St.|Ave|Rd|Blvd|Parkway|Row|Yard|Green|Grove", "High Church Station King's Queen's Mill Park Victoria Oak Elm Maple Cedar Bridge School North West Chapel Market Castle Baker Abbey Lake River Orchard Lower Upper Old New St.".split()),
    "de": ("straße|str.|weg|allee|gasse|platz|ufer|ring|damm|markt|steig|graben", "Haupt Schul Garten Bahnhof Linden Kirch Wald Berg Mühlen Rosen Schiller Goethe Buchen Eichen Markt Brunnen Schloss Bach Wiesen Kaiser Hof Post Stein Feld".split()),
    "fr": ("rue|avenue|boulevard|place|impasse|chemin|allée|quai|route|cours|passage|square", "de la Gare|de l'Église|des Lilas|du Moulin|Victor Hugo|de la République|des Écoles|du Château|Pasteur|de Verdun|des Jardins|Saint-Jacques|du Général Leclerc|de la Paix|des Tilleuls|du Vieux Pont".split("|")),
    "es": ("calle|plaza|avenida|paseo|camino|ronda|C/|Avda.|travesía|carretera|cuesta|glorieta", "Mayor|del Sol|de la Iglesia|Real|de la Constitución|San Juan|Cervantes|de los Álamos|del Pino|Nueva|de Colón|de la Fuente|Goya|Santa Ana|del Carmen|de las Flores".split("|")),
}
STREET_FORMS = {"de": ["Am {w}", "An der {w}", "Auf dem {w}", "Im {w}", "Zum {w}", "Alter {w}", "Unter den {w}", "Hinter der {w}", "Straße des {w}", "Straße der {w}", "Platz der {w}", "Neue {w}gasse"]}
WATERS = "Bach Brunnen Mühle Anger Linden Graben Steinbruch Kirche Markt Friedens Einheit Burg Hang Weiher Tor Eichen".split()
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
PHONES = [
    "+44 00 0000 0000", "+44 0000 000000", "000 0000 0000", "00000 000000", "(000) 000-0000", "000-000-0000", "000.000.0000", "+1 000 000 0000", "+1-000-000-0000", "1-000-000-0000", "(00000) 000 000",
    "+49 00 00000000", "+49 000 0000000", "+49 00 00000 000", "+49 00 00000-000", "000/00000000", "000 / 000 00 00", "0000-0000000", "0000 0000000", "(000) 00000 000", "00 000 000 00 00", "0044-0000-000000", "0033 0 00 00 00 00", "0049 00 0000000",
    "+33 0 00 00 00 00", "+33 (0)0 00 00 00 00", "00 00 00 00 00", "00.00.00.00.00", "+34 000 000 000", "+34 00 000 00 00", "000 00 00 00", "000 000 000", "00 000 00 00", "+000 00 000 000", "(+000) 00 000 000", "+000-00000000",
]
IDS = [
    "000-00-0000", "000 00 0000", "000-00-0000", "ZX 00 00 00 Z", "ZX000000Z", "ZX 000000 Z", "000000000", "Z00000000", "ZX0000000", "ZX 0000000", "Z0000000", "00 000 000 000", "00000000000", "00/000/00000", "00 000000 Z 000", "Z00ZX00Z0", "ZXZ000000",
    "0 00 00 00 000 000 00", "000000000000000", "00ZX00000", "00000000Z", "00000000-Z", "00.000.000-Z", "00.000.000Z", "X-0000000-Z", "Y0000000Z", "00/00000000/00", "ZXQ 000000", "000000-0000", "000000-000Z",
]
FILES = ["0000-000-00", "0000-000-00", "0000-0000-0", "00-0000-000", "Z 000/00", "0 Z 000/00", "XX-0000-000", "0000/000", "00-00.000", "0:00-cv-00000", "INV-00000", "00/0000", "XXZ 00/0000", "Z-000/00", "0000-00-000", "F0000-000", "00 O 000/00", "[0000] XXZ 000", "RG 00/00000", "XX00 0000/00-Z0", "000-0000-0000/00"]
HIDDEN = ["[redacted]", "█████", "████ ██████", "[…]", "***", "N. N.", "X.", "X…", "[name withheld]", "[anonymisiert]", "[nom occulté]", "[nombre omitido]", "(name withheld)", "Y...", "XXX", "[X]"]
COVERED = ["[address withheld]", "███ ██████", "[…]", "[…]@[…]", "███@███", "[phone removed]", "[Anschrift geschwärzt]", "****00", "***-**-0000", "██████", "+00 ███ ███", "[numéro occulté]", "[dato suprimido]", "██ ██ 00", "00 ████"]
HOSTS = ["example.com", "example.org", "mail.example", "post.test", "gmail.com", "web.de", "orange.fr", "correo.example.es", "law-firm.example", "uni.test", "outlook.com", "my-post.example.net", "example.co.uk"]
#: Common words, for sentences without sense.
COMMON = {
    "en": "the a of and in to was by for on with at from that which had has been not his her their its this it is were be or as after before when who said made paid gave took left asked found held signed called sold bought heard called it and the of in to two three first last year month house contract letter money goods order claim evidence reasons hearing morning office account later also only still never",
    "de": "der die das und in zu den von mit dem des ein eine nicht ist war hat wurde sich auf für im am bei nach aus dass sie er es auch als wie noch über vor zum zur durch sagte gab nahm ließ fand hielt rief verkaufte zahlte Haus Vertrag Brief Geld Ware Antrag Frage Anspruch Gründe Termin Büro Konto Jahr Monat Verfahren Partei Frist Recht Sache Schaden Grund Teil Zeit Seite Verhandlung Aussage Zahlung später nur wieder",
    "fr": "le la les de des du et en un une dans pour par sur avec au aux que qui ne pas est était a ont été son sa ses leur ce cette il elle se dit fit prit vendu payé signé demandé entendu trouvé tenu maison contrat lettre argent ordre demande preuve motifs audience matin bureau compte année mois après avant aussi seulement encore jamais comme selon",
    "es": "el la los las de del y en un una que con por para al a no es era fue ha han sido su sus se lo este esta dijo hizo dio vendió pagó firmó pidió oyó encontró casa contrato carta dinero orden demanda prueba motivos vista mañana oficina cuenta año mes después antes también solo todavía nunca como según sobre entre",
}
_SAME = ["{N}"] * 9 + ["{C}", "{L}", "{t} {S}", "{t} {S}", "{t} {S}", "{E}", "{T}", "{T}", "{A}", "{A}", "{A}", "{o}", "{o}", "{b}", "{d}", "{d}", "{k}", "{x}", "{m}", "{r}", "{q}", "{p}", "{p}", "{v}", "{v}", "{g}", "{u}", "{p}, {z}", "{z} {p}", "{c}", "{c}", "{k}", "{k} [[for|über|de|,]] {m}"]
#: Slots with the words that often stand before them.
PARTS = {
    "en": [*_SAME, "phone {T}", "call {T}", "tel. {T}", "passport {I}", "passport no. {I}", "SSN {I}", "insurance number {I}", "tax number {I}", "identity card {I}", "security number {I}", "passport number was {I}", "[[tax|insurance|identity]] [[number|card|code]] [[reads|is|of]] {I}", "taxpayer {I}", "at {A}", "of {A}", "c/o {A}", "in {p}", "from {p}", "file {k}", "invoice {k}", "no. {k}", "section {x}", "page {x}", "with {N}", "to {N}", "{N}'s", "{t} {S}'s", "of {o}", "{t} {r}", "witness {N}", "counsel {N}", "judge {S}", "{C} [[Decided|Filed|Heard|Delivered|Argued]] on {d}", "{L} [[Decided|Filed|Heard|Delivered|Argued]] on {d}", "{N} [[Summary|Reasons|Facts|Held|Judgment]]", "{A}, {p}"],
    "de": [*_SAME, "Tel. {T}", "Telefon {T}", "unter {T}", "Ausweis {I}", "Pass {I}", "Reisepass Nr. {I}", "Steuer-ID {I}", "Steuernummer {I}", "Versicherungsnummer {I}", "[[Passnummer|Steuernummer|Ausweisnummer]] [[ist|war|mit|lautet]] [[der|die|]] {I}", "Personalausweis {I}", "in der {A}", "c/o {A}", "in {p}", "aus {p}", "Az. {k}", "Rechnung {k}", "Nr. {k}", "§ {x}", "Seite {x}", "mit {N}", "an {N}", "von {N}", "Frau {S}", "Herrn {S}", "der {o}", "Herr {r}", "Zeuge {N}", "RA {N}", "Richterin {S}", "{N} [[Gründe|Tatbestand|Leitsatz|Tenor|Entscheidung]]", "[[Frist|Frage|Haftung|Einrede]] von Amts wegen", "{A}, {z} {p}", "{A} in {p}"],
    "fr": [*_SAME, "tél. {T}", "au {T}", "passeport {I}", "passeport n° {I}", "numéro fiscal {I}", "sécurité sociale {I}", "sous le n° {I}", "numéro [[fiscal|d'assuré|de passeport]] [[est|était|:]] [[le|]] {I}", "pièce d'identité {I}", "carte d'identité {I}", "au {A}", "du {A}", "chez {N}", "à {p}", "de {p}", "n° {k}", "facture {k}", "article {x}", "page {x}", "avec {N}", "à {N}", "de {N}", "Mme {S}", "M. {S}", "la société {o}", "M. {r}", "témoin {N}", "Me {S}", "Me {N}", "{N} [[Motifs|Faits|Sommaire|Résumé|Décision]]", "{A} à {p}", "{A} à {p}"],
    "es": [*_SAME, "tel. {T}", "al {T}", "teléfono {T}", "pasaporte {I}", "DNI {I}", "NIF {I}", "NIE {I}", "documento {I}", "[[NIF|DNI|número de pasaporte]] [[es|era|con]] [[el|]] {I}", "afiliación {I}", "número {I} de la Seguridad Social", "en {A}", "de {A}", "en {p}", "de {p}", "n.º {k}", "factura {k}", "artículo {x}", "folio {x}", "con {N}", "a {N}", "de {N}", "D. {S}", "Sra. {S}", "la mercantil {o}", "D. {r}", "testigo {N}", "don {N}", "doña {N}", "{N} [[Fundamentos|Antecedentes|Extracto|Resumen|Fallo]]", "{A} de {p}", "{A}, de {p}"],
}
LABELS = {"N": "NAME", "C": "NAME", "L": "NAME", "S": "NAME", "T": "PHONE", "E": "EMAIL", "I": "ID", "A": "ADDRESS"}
ONSETS = "b br c ch cl d dr f fl g gr h j k kl l m n p pr qu r s sch st t tr v w y z".split()
NUCLEI = [*"aeiouaeiouaeiou", "ai", "au", "ei", "ie", "ou", *"öüéáíóäè"]
CODAS = ["", "", "", *"n r l s t d k m".split(), "nd", "rt", "ck", "ll", "ng", "ss", "tz", "rn", "lm", "sk", "x"]


class Maker:
    """Values of slots; the same seed gives the same table."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def shape(self, kinds: list[str]) -> str:
        """One of the kinds, with a digit for 0 and a letter for X, Z and Q."""
        r = self.r
        text = "".join(r.choice("0123456789") if c == "0" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c in "XZQ" else c for c in r.choice(kinds))
        return text

    def syllables(self, least: int = 1, most: int = 3) -> str:
        """A word that nobody knows."""
        r = self.r
        word = "".join(r.choice(ONSETS) + r.choice(NUCLEI) + (r.choice(CODAS) if r.random() < 0.5 else "") for _ in range(r.randint(least, most)))
        return (word + r.choice(CODAS[3:] + ["o", "a", "e", "é", "ez", "er", "son", "ski", "ini"])).capitalize()

    def given(self, lang: str) -> str:
        r = self.r
        name = self.syllables(1, 2) if r.random() < 0.5 else r.choice(GIVEN[lang if r.random() < 0.8 else r.choice(list(GIVEN))])
        if r.random() < 0.07:
            name += "-" + (self.syllables(1, 2) if r.random() < 0.5 else r.choice(GIVEN[lang]))
        return name

    def surname(self, lang: str) -> str:
        r = self.r
        name = self.syllables(1, 3) if r.random() < 0.6 else r.choice(SURNAMES[lang if r.random() < 0.8 else r.choice(list(SURNAMES))])
        if r.random() < 0.1:
            name += "-" + (self.syllables(1, 2) if r.random() < 0.5 else r.choice(SURNAMES[lang]))
        elif lang == "es" and r.random() < 0.3:
            name += " " + (self.syllables(1, 2) if r.random() < 0.5 else r.choice(SURNAMES[lang]))
        return r.choice(MARKS) + name if r.random() < 0.13 else name

    def place(self, lang: str) -> str:
        r = self.r
        if r.random() < 0.4:
            return r.choice(PLACES[lang])
        if r.random() < 0.5:
            return self.syllables(1, 2)
        name = self.syllables(1, 1) + r.choice(TOWN_ENDS[lang])
        return r.choice(["Saint-", "Sankt ", "Bad ", "North ", "San ", "Villa "]) + name if r.random() < 0.12 else name

    def street(self, lang: str) -> str:
        r = self.r
        kinds, words = STREETS[lang]
        kinds = kinds.split("|")
        if lang == "de":
            if r.random() < 0.4:
                return r.choice(STREET_FORMS["de"]).replace("{w}", r.choice(WATERS) if r.random() < 0.5 else self.syllables(1, 1) + r.choice(WATERS).lower())
            if r.random() < 0.08:
                return f"{self.given(lang)}-{self.surname(lang)}-{r.choice(['Straße', 'Str.', 'Platz', 'Allee', 'Weg'])}"
            if r.random() < 0.2:
                return f"{self.syllables(1, 2)}er {r.choice(['Straße', 'Weg', 'Allee', 'Chaussee'])}"
            return (r.choice(words) if r.random() < 0.6 else self.syllables(1, 2)) + r.choice(kinds)
        if lang == "en":
            word = r.choice(words) if r.random() < 0.6 else self.syllables(1, 2) + r.choice(["", "", "'s"])
            if word == "St.":
                word += " " + self.syllables(1, 2) + "'s"
            return f"{'Old ' if r.random() < 0.1 else ''}{word} {r.choice(kinds)}" if r.random() < 0.92 else f"The {r.choice(['Ropery', 'Mount', 'Mall', 'Strand', 'Paddock'])}"
        word = r.choice(words) if r.random() < 0.5 else f"{self.given(lang)} {self.surname(lang)}" if r.random() < 0.25 else r.choice(["", "de ", "du ", "des "] if lang == "fr" else ["", "de ", "del ", "de la "]) + self.syllables(1, 2)
        kind = r.choice(kinds)
        return f"{kind.capitalize() if r.random() < 0.15 else kind} {word}"

    def firm(self, lang: str) -> str:
        r = self.r
        forms, trades = FIRMS[lang]
        if lang == "en" and r.random() < 0.08:
            return r.choice(["Bank of {}", "The {} Railway Company", "{} Airport Authority", "Chamber of Commerce of {}", "The {} Electricity Board", "Friends of {} Society"]).format(self.place(lang))
        name = r.choice([self.place(lang), self.syllables(1, 2), r.choice(SURNAMES[lang]), f"{self.syllables(1, 2)} {self.syllables(1, 2)}", r.choice(["Royal", "Nova", "Delta", "Atlas", "Union", "Alpha"])])
        trade = " " + r.choice(trades) if r.random() < 0.65 else ""
        if lang in ("fr", "es") and trade and r.random() < 0.5:
            return f"{trade[1:]} {name} {r.choice(forms)}"
        return f"{name}{trade}{' ' + r.choice(forms) if r.random() < 0.85 or not trade else ''}"

    def phone(self) -> str:
        """A telephone number of any country's way of grouping."""
        r = self.r
        groups = r.choice([[3, 3, 4], [5, 6], [4, 7], [2, 2, 2, 2, 2], [3, 3, 3], [3, 2, 2, 2], [4, 3, 3], [5, 3, 3], [3, 7], [2, 3, 4], [2, 8], [4, 5, 4], [3, 4, 4], [2, 4, 4], [3, 8]])
        sign = r.choice([" ", " ", " ", "-", ".", ".", "/"])
        digits = ["".join(r.choice("0123456789") for _ in range(n)) for n in groups]
        if r.random() < 0.3:
            return r.choice(["+", "+", "00"]) + self.shape(["00", "0", "000"]) + r.choice([" ", " ", "-", "/"]) + sign.join(digits)
        if r.random() < 0.25:
            return f"({digits[0]}){r.choice([' ', ' ', '', '-'])}{sign.join(digits[1:])}"
        return ("0" + digits[0][1:] if r.random() < 0.6 else digits[0]) + sign + sign.join(digits[1:]) if sign != "/" else f"{digits[0]}/{''.join(digits[1:])}"

    def loose(self, lang: str) -> str:
        """A pattern of common words in no order, and of words that nobody knows, around slots: a value
        is known by itself where its neighbours tell nothing."""
        r, common = self.r, COMMON[lang].split()

        def words(least: int, most: int) -> str:
            out = []
            for _ in range(r.randint(least, most)):
                chance = r.random()
                word = self.syllables(1, 2) + r.choice(["", "ung", "heit", "keit", "schaft"][: 5 if lang == "de" else 1])
                known = r.choice(common)
                out.append((known.capitalize() if chance < 0.06 else known) if chance < 0.7 else word.lower() if lang != "de" or chance < 0.82 else word)
            return " ".join(out)

        text = words(0, 4)
        for _ in range(r.randint(1, 3)):
            part = r.choice(PARTS[lang])
            text += r.choice([" ", " ", " ", ", ", ": ", " (", "; "] if text else [""]) + part
            if text.count("(") > text.count(")"):
                text += ")"
            if r.random() < 0.15:  # a sentence ends here, or a line
                more = words(1, 4)
                text += r.choice([".", ".", "", ";"]) + " " + more[:1].upper() + more[1:]
            else:
                text += r.choice(["", "", ",", ";"]) + " " + words(0, 4)
        text = text.replace("  ", " ").strip()
        return text[:1].upper() + text[1:] + r.choice([".", ".", ".", "", ";", ":"]) if text[:1] != "{" else text + r.choice([".", ".", ""])

    def fill(self, slot: str, lang: str) -> str:
        r = self.r
        if slot == "N":
            given = self.given(lang) if r.random() < 0.83 else r.choice("ABCDEFGHIJKLMNOPRSTUVWYZÉ") + "."
            middle = f" {r.choice('ABCDEFGHIJKLMNOPRSTW')}." if r.random() < 0.12 else f" {self.given(lang)}" if r.random() < 0.06 else ""
            last = self.surname(lang)
            if r.random() < 0.03:
                last = r.choice("ABCDEFGHKLM") + ". " + last
            return f"{given}{middle} {last.upper() if r.random() < 0.12 else last}"
        if slot == "C":
            return self.fill("N", lang).upper() if r.random() < 0.85 else self.fill("N", lang)
        if slot == "L":
            last, given = self.surname(lang), self.given(lang) if r.random() < 0.88 else r.choice("ABCDEFGJKLMPRST") + "."
            return f"{last.upper() if r.random() < 0.4 else last}, {given}"
        if slot == "S":
            return self.surname(lang).upper() if r.random() < 0.1 else self.surname(lang)
        if slot == "v":
            return self.surname(lang)
        if slot == "T":
            return self.shape(PHONES) if r.random() < 0.6 else self.phone()
        if slot == "E":
            a, b = self.given(lang), self.surname(lang)
            local = r.choice([f"{a}.{b}", f"{a[0]}.{b}", f"{a}{self.shape(['00', '0000'])}", f"{a}_{b}", f"{b}+list", f"{a}-{b}", "info", "office", b])
            local = "".join(c for c in unicodedata.normalize("NFD", local.lower()) if c.isascii() and (c.isalnum() or c in "._+-"))
            host = r.choice([*HOSTS, re.sub("[^a-z]", "", self.syllables(1, 2).lower()) + r.choice([".com", ".example", ".test", ".de", ".org"])])
            dotted = host.replace(".", r.choice(["[dot]", "(dot)"]))
            mail = r.choice([f"{local}@{host}"] * 6 + [f"{local} (at) {host}", f"{local} @ {host}", f"{local}[at]{dotted}", f"{local} [at] {host}", f"{local}(at){dotted}"])
            return mail.upper() if r.random() < 0.12 else mail
        if slot == "I":  # now and then with the code of a country in front
            return (self.shape(["ZX "]) if r.random() < 0.12 else "") + self.shape(IDS)
        if slot == "A":
            street, n = self.street(lang), self.shape(["0", "00", "00", "000", "00"]).lstrip("0") or "7"
            if lang == "en":
                text = f"{n}{r.choice(['', '', '', '', 'A', 'b', 'C', '-' + str(int(n) + 2)])} {street}"
            elif lang == "de":
                text = f"{street} {n}{r.choice(['', '', '', '', 'a', ' b', 'C', '–' + str(int(n) + 2), '-' + str(int(n) + 3), '/' + str(1 + int(n) % 9)])}"
            elif lang == "fr":
                text = f"{n}{r.choice(['', '', '', ' bis', ' ter', 'B'])}{r.choice([' ', ', '])}{street}"
            else:
                text = f"{street}{r.choice([' ', ', ', ' n.º ', ', n.º ', ', núm. '])}{n}{r.choice(['', '', '', ' bis'])}"
            return text.upper() if r.random() < 0.06 else text
        if slot == "u":
            return r.choice(HEADS[lang].split("|")).replace("{p}", self.place(lang).upper())
        if slot == "g":
            return r.choice(THINGS[lang].split("|"))
        if slot == "b":
            return r.choice(BODIES[lang]).replace("{p}", self.place(lang)).replace("{x}", self.shape(["0", "00"]))
        if slot == "c":  # a place in a series of reports, of a real or an unknown name
            series = r.choice(["QB", "WLR", "AC", "All ER", "F.2d", "F.3d", "U.S.", "NJW", "WM", "BGHZ", "JCP", "Bull. civ.", "Lloyd's Rep.", "L. Rev.", "RJ", "RTD civ.", self.syllables(1, 1)[:4] + ". Rep.", self.syllables(1, 1)[:4] + ". L.J.", f"{self.syllables(1, 1)[:3]}. App.", self.shape(["X.Z.", "XZ", "X.Z.Q.", "XZQ"]) + r.choice(["", "-ZX"])])
            return r.choice([f"[{self.shape(['0000'])}] {self.shape(['0', '00'])} {series} {self.shape(['00', '000'])}", f"{self.shape(['0', '00', '000'])} {series} {self.shape(['0', '00', '000', '0000'])}", f"({self.shape(['0000'])}) {self.shape(['0', '00'])} {series} {self.shape(['0', '00', '000'])}", f"{series} {self.shape(['0000'])}, {self.shape(['00', '000'])}"])
        if slot == "t":
            return r.choice(TITLES[lang])
        if slot == "d":
            month, day, year = r.choice(MONTHS[lang]), str(r.randint(1, 28)), str(r.randint(1985, 2025))
            long = {"en": r.choice([f"{day} {month} {year}", f"{month} {day}, {year}", f"{month} {year}"]), "de": f"{day}. {month} {year}", "fr": f"{day} {month} {year}", "es": f"{day} de {month} de {year}"}[lang]
            return r.choice([long, long, long, self.shape(["00/00/0000", "00.00.0000", "0000-00-00", "0/00/0000", "0.0.0000"])])
        if slot == "p":
            return self.place(lang)
        if slot == "z":
            return self.shape(["XZ0 0ZX", "XZ00 0ZX", "X0 0XZ", "00000"]) if lang == "en" else self.shape(["00000"])
        if slot == "o":
            return self.firm(lang)
        if slot == "x":
            return self.shape(["0", "00", "000", "0000", "00000", "X00", "00.0", "0.000", "0000:00", "000 000", "0a", "IV"])
        if slot == "m":
            amount = self.shape(["0,000", "00,000.00", "000", "000,000.00", "0.000", "00.000,00", "00 000,00", "0 000", "00 000", "000 000"])
            return r.choice([f"£{amount}", f"${amount}", f"EUR {amount}", f"{amount} €", f"{amount} EUR", f"{amount} euros", f"USD {amount}"])
        if slot == "r":
            a, b = r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ"), r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ")
            return r.choice([*HIDDEN, f"{a}.", f"{a}. {b}.", f"{a}.{b}.", f"{a}. de {b}.", f"{a}…", f"{a}. v. {b}.", f"{a}."])
        if slot == "q":
            return self.shape(COVERED) if r.random() < 0.8 else r.choice(HIDDEN)
        return self.shape(FILES)

    def spelt(self, text: str) -> str:
        """A value as copies of a text have it: now and then with its letters taken apart, wrongly
        decoded, or with a soft hyphen."""
        chance = self.r.random()
        if chance < 0.03:
            return unicodedata.normalize("NFD", text)
        if chance < 0.05 and not any(ord(c) > 255 for c in text):
            return text.encode("utf-8").decode("latin-1")
        if chance < 0.06 and len(text) > 8 and text[3].isalpha() and text[4].isalpha():
            return text[:4] + "­" + text[4:]
        return text


def table(repeat: int = 12, seed: int = 20) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans (begin, end, kind)) of `repeat` fillings of each pattern and of as many sentences
    without sense: the labelled rows, whose number is thereby bounded. Some are hard-wrapped, and some
    begin with a paragraph's number."""
    make, out = Maker(seed), []
    r = make.r
    for lang, patterns in PATTERNS.items():
        lines = patterns.strip().splitlines()
        for pattern in [*lines, *[None] * len(lines)]:
            for _ in range(repeat):
                pattern = make.loose(lang) if pattern is None or pattern not in lines else pattern
                chosen = re.sub(r"\[\[(.*?)\]\]", lambda m: r.choice(m[1].split("|")), pattern)
                text, spans, at = "", [], 0
                if r.random() < 0.2:
                    text = make.shape(["[0] ", "0) ", "§ 0 ", "(00) ", "0. ", "00 ", "00. ", "- ", "[00] ", "• ", "Rn. 00: ", "§0 "])
                for m in re.finditer(r"\{(\w)\}", chosen):
                    text += chosen[at : m.start()]
                    slot = m[1]
                    if slot in LABELS and r.random() < 0.1:  # one value of several may be blacked out
                        slot = "r" if LABELS[slot] == "NAME" else "q"
                    value = make.fill(slot, lang)
                    if slot in LABELS:
                        value = make.spelt(value) if LABELS[slot] in ("NAME", "ADDRESS") else value
                        spans.append((len(text), len(text) + len(value), LABELS[slot]))
                    text += value
                    at = m.end()
                text += chosen[at:]
                if r.random() < 0.25:
                    text = "".join("\n" if c == " " and r.random() < 0.15 else c for c in text)
                out.append((text, spans))
    return out
