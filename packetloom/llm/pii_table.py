"""The small labelled table from which the field is trained: marked contexts, filled deterministically.

``POSITIVE`` lines hold slots ({name}, {email}, {phone}, {id}, {address}); ``NEGATIVE`` lines hold none of the
kinds, though many look alike. ``#`` stands for a digit, ``@w``/``@W`` for a code word.
"""

from __future__ import annotations

import random
import re

POSITIVE = """
{name}
— {name}
-- {name}
Reviewed-by: {name} <{email}>
Signed-off-by: {name} <{email}>
Co-authored-by: {name} <{email}>
Signed-off-by: {name}
# TODO({name}): remove this after the migration
// FIXME({name}): drop the @w
git blame: {name} 20##-##-##
Author: {name}
{name} wrote: the export still fails on page two
thanks to {name} for the repro
Per {name}, nobody may restart the queue
per {name}, the @w stays off
cc {email}, {name}
cc {name}
escalate to {phone} after midnight, then to {name}
escalate to {name} first
new hire: {name}, {phone}
row ##: {name};{email};{phone}
| {name} | on call | {phone} |
{"customer": "{name}", "phone": "{phone}", "city": null}
  "email": "{email}",
  "name": "{name}",
VALUES ('{name}', '{phone}', '{address}')
VALUES ('{name}', '{phone}', '{address}
INSERT INTO accounts VALUES (####, '{name}', '{email}');
<td>{name}</td><td>{address}</td>
<td>{name}</td><td>{address}
owner = "{name}"  # {email}
owner: {name}
assert mask("{email}") == "***"
assert mask("{phone}") == "***"
GET /users?mail={email}&page=3
mailto:{email}?subject=rollback
user_email={email} plan=team status=active
20##-##-##T##:##:##Z WARN login failed for {email} from ##.0.3.7
{email} opened the pull request, {name} merged it
ask {name} ({email}) before touching the @w shard
Avisa a {name} ({email}) antes del despliegue.
Bitte {name} unter {phone} anrufen.
Rückfragen an {email}.
Merci de rappeler {name} au {phone}.
Écrivez à {email} pour l'accès.
Le client {name} habite {address}
Le client {name} habite {address} et paie
请联系 {name}，电话 {phone}。
邮箱：{email}
担当者 {name} <{email}> に確認
担当者 {name} に確認
電話 {phone} まで
证件 {id} 出现在日志里
Contact: {email}
contact {name} at {phone}
- [x] {name} confirmed the fix
- [ ] ask {name} about the @w
@@ address of record: {address}
address of record: {address}
Teléfono de contacto: {phone}
Hi, this is {name} from billing; reach me on {phone} or {email}.
my number is {phone}, and I live at {address}
call {phone} if the pager stays silent
SMS to {phone} bounced twice
phone: '{phone}'
tel: {phone}
Customer {name} reports a double charge, {id}.
the ticket had {id} pasted into it
patient record {id} leaked into the fixture
The caller gave {id} and then hung up
El registro contiene {id}.
Numéro fourni : {id}.
Im Protokoll steht {id}.
{id}
  {id}
Ship the replacement disk to {address}
courier could not find {address}
billing address: {address}
shipping_address = "{address}"
Lieferanschrift: {address}
Enviar a {address}
Deliver to {name}, {address}
$ whois says {name}, {address}
{phone}
{email}
{address}
""".strip("\n").split("\n")

NEGATIVE = """
Found #### matches for @w_@w in src/@w/@w/@w_@w.py, none of them in the hot path.
Don't touch /work/@w/@w/@w_@w.json until run #### has finished.
Next step: @w /srv/app/@w/@w/@w_@w.rs, then compare the @w digests.
We're at #### of ### tokens, so the @w has to be dropped.
p95 latency went from ####ms to ##ms after we @w the @w.
Noted: the lazy @w stays untouched, and we'll revisit the @w on day ##.
Let's keep the @w at #### and @w only what the @w needs.
@W Core and @W Index share the same cold @w.
Meridian Core and Ledger Index share the same torn @w.
Release notes, Harbour Light ##: @w is now safe for frozen @ws.
Release notes, @W @W ##: merge is now safe.
Merge branch 'Harbour Light' into Meridian Core
Merge branch '@W @W' into @W @W
The test failed because @w_@w expects a @w, but the @w was already sealed.
It doesn't look like the @w was ever written; they'd have seen exit code ##.
Why would a greedy @w replay twice? I can't reproduce it locally.
The slow @w in `@W@W` still reads #### rows before it gives up.
Can you @w the @w and tell me why the @w count is ####?
@w_@w() returns a stale @w when the @w is empty; that's the bug we've been chasing.
I'll @w the @w first and re-run the strict benchmark afterwards.
Bitte prüfe zuerst, ob @w_@w überhaupt aufgerufen wird.
Bitte prüfe zuerst, ob @W@W überhaupt aufgerufen wird. Größere Änderungen erst nach Lauf ####.
Die Größe des Puffers beträgt ####; das genügt für die Übertragung nicht.
Der Schlüssel fehlt, daher schlägt die Überprüfung fehl.
Der @w in src/@w/@w/@w_@w.sql wird nach #### Zeilen abgebrochen.
Warum läuft das so langsam? Früher waren es ## ms.
Le @w « @W@W » reste bloqué après #### lignes, c'est gênant.
Où se trouve la sauvegarde du @w ? Elle a été déplacée hier.
Le délai est passé de #### ms à ### ms.
L'index n'était pas à jour ; la file contient #### éléments.
J'ai relancé le test : #### réussites, ## échecs.
Il faut d'abord vérifier /work/@w/@w/@w_@w.ts avant de déployer.
El @w de @w/@w/@w_@w.py falla después de #### filas.
El tiempo bajó de #### ms a ### ms según el último informe.
Añadí una comprobación; el @w ya no se duplica. ¿Puedes revisar @w_@w antes de la próxima migración?
La cola tenía #### mensajes y ahora sólo quedan ##.
一共找到####条结果，其中##条重复。 缓存已经过期，请不要修改迁移编号。
テストは####件成功、##件失敗しました。 キャッシュを消してから、もう一度実行します。
要約には数値が残っていません。
20##-##-##T##:##:##.###Z ERROR @w_@w failed: exit code ##
20##-##-##T##:##:##.###Z INFO  @w_@w: deep @w rows=##### elapsed=###.#ms
20##-##-##T##:##:##.###Z WARN  retry #/# for @w (torn)
##.##.##.### - - [20##-##-##T##:##:##.###Z] "GET /@w/#####" 200 ####
p50=##.# p95=###.# p99=###.# n=#####
#####  @w.remote  ########
ok   @w/@w/noisy	#.###s
PASSED tests/test_@w.py::test_@w_@w [##%]
FAILED tests/test_@w.py::test_@W@W - AssertionError: ##### != #####
@@ -###,# +##,# @@ @W@W
diff --git a/@w b/@w
-rw-r--r-- 1 build build  ##### Sep ## 0#:14 empty_@w.py
  File "/srv/app/@w/@w/@w_@w.py", line ##, in @w_@w
src/@w/@w/@w_@w.java:###:##: @W@W
/work/@w/@w/@w_@w.go:##:#: @w_@w
## Quiet @w
## Torn @W
| @w | hot | #### |
> nightly @w was cold
- [ ] @w the partial @w
- [x] @w the remote @w
* `@w_@w`: strict @w, default ###
6. Parse `@w_@w` in /work/@w/@w/@w_@w.py
def @w_@w(@w, greedy=####):
    func (s *@W) @W_@W(ctx context.Context) error {
        const @w = await @w@W({ nightly: #### });
    let mut @w: Vec<u##> = Vec::with_capacity(####);
            SELECT @w, count(*) FROM @w_@w WHERE hot > #### GROUP BY 1;
        raise ValueError("lazy @w: ####")
assert @w@W(####) == @w, quiet
return @w if frozen else @W@W()
@w = @w_@w(torn)[##:]
for @w in @w_@w(deep):
[@w.partial]
@@w.route("/cold/<int:@w>")
    export @W_LIMIT=####
  @w: ####
import @w.@w as ha
} catch (@WError e) { hot.@w_@w(e); }
    # @w the stale @w before the next run
version #.#.###.####-rc#
version #.##.#.####-rc1
build 20######-#### took ##### ms.
build 20######-#### took ##### ms
epoch ##########
rows=###########
rows=##########
request_id=########-####-####-####-############
host ##.###.##.# port ####
host ##.##.##.### port ####
PO-#### shipped in lane #
ticket LDG-####-##-#### is closed
ticket @W-###-##-#### was reopened
Ledger Index: ###-## pages, ISBN-like 978-0-####-####
ISBN 978-#-####-####-#
the social security of the @w module is its name.
the passport of the @w service expired
phone home disabled (@w.telemetry=false)
Main Street is the code name of branch ####
High Street is a release name
see section #, Road Map.
see chapter #, Lane Change
contact [EMAIL] or [PHONE] for access
[NAME] lives at [ADDRESS]
git clone git@code.@w.example:@w/core.git
git clone git@git.@w.test:@w/@w.git
npm i @@w/tools@#.#.#
uses: actions/@w@v#
uses: @w/@w@v##
ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAA######### @w@build
postgres://@w:${DB_PASSWORD}@db.@w.example/@w
curl -H "Authorization: Bearer $TOKEN" https://api.@w.example/v1
sha256:################  src/@w/@w.py
commit ##a##c##d##e##f##
etag: "##c##a##d###"
"integrity": "sha###-Sy###us##tjo##=="
status: done, shipped by the night shift
café vs café, naïve vs naïve
WE'LL SEE, IT'S they'Ve don't y'all'd
col_a		col_b	 	col_c
prompt ends with <|endoftext|> and then goes on
нет мир, лог пуст
@W QX# #ZZ
Ostermoor QX# #ZZ</td>
Nether Hollin QX# #ZZ')
Tolverton, ZZ 00###
Villarroa
[REDACTED] and [MASKED]
@W@W() returns a nested @w; Can you @w the @w? Let's keep the @w at ####.
Next step: @w @w/@w/@w_@w.md, then compare. Release notes, Harbour Light ##: fold is now safe.
You are a careful engineer working on @w.
  password: <your-password>
apiKey: "YOUR_API_KEY_HERE"
secret: !vault @w/db#password
The Quiet @W is on call
Thanks to the Night Shift for the repro
Summary of Open Issues
Pull Request Review
Hello World
Error Budget Policy and Change Log
""".strip("\n").split("\n")

WORDS = (
    "harbour quarry ember thistle lantern willow juniper cobalt saffron meridian orchard basalt webhook loader shard segment cursor partition gate margin journal tenant router cache payload "
    "queue checkpoint snapshot seed header footer bucket lattice replica token closure window session packet fixture harness probe quorum ledger backlog bloom lease edge digest index parser "
    "excerpt summary sidecar anchor budget invoice migration counter cluster worker carrier manifest transcript baseline adapter receipt scheduler pack merge split rank fold drain verify"
).split()

HOSTS = "thistle.invalid saffron.test quarry.example mail.orchard.example post.juniper.example lantern-labs.test corp.example acme.test".split()

PHONES = (
    "(###) 555-01##", "###-555-01##", "###.555.01##", "+1 ### 555 01##", "+1###55501##", "tel:+1-###-555-01##", "555-01## ext. ##", "07700 900###", "+44 20 7946 0###", "+44 7700 900###",
    "+49 (0)30 23125-###", "0049 30 23125###", "030 23125 ###", "+33 1 99 00 ## ##", "01.99.00.##.##", "+34 900 000 ###", "+41 44 555 ## ##", "0#########",
)

IDS = (
    "SSN ###-##-####", "ssn=#########", "social security number 987-65-43##", "\"national_id\": \"9##-##-####\"", "national id ######-####", "passport no. XZ99#####", "Passport: X*#######", "DNI 99######-*",
    "nino: QQ######*", "NINO QQ ## ## ## *", "Steuer-ID 00 ### ### ###", "Personalausweis-Nr. LZ99#####", "driver licence D-99####-###", "driving license no. D-######-###", "n° de sécurité sociale 1 99 99 99 ### ###",
    "tax id ##-#######", "passport LZ#######", "Ausweis LZ######*",
)

STREETS = ("Larkgate", "Ashcombe", "Millwick", "Ferrymoor", "Hazelfield", "Cinderwick", "Tolverton", "Quernmoor", "Birchmoor", "Stonewell")
KINDS_OF_STREET = ("Street", "Lane", "Road", "St.", "Ave.", "Court", "Mews", "Avenue", "Close", "Drive")
TOWNS = ("Ostermoor", "Bracksea", "Nether Hollin", "Tolverton", "Quernham", "Valmère", "Villarroa", "Upper Wending")

GIVEN = ("Arlo", "Benita", "Cedric", "Dorothea", "Elif", "Farid", "Greta", "Hugo", "Inés", "Jonas", "Katya", "Léonie", "Marek", "Noémie", "Otto", "Paula", "Ravi", "Selma", "Tomás", "Ute")
FAMILY = ("Abernal", "Brookvane", "Castelmar", "Dunwick", "Eskelund", "Farrowby", "Grunholt", "Hartenshaw", "Iverlund", "Jastrow", "Kestermann", "Lundgrave", "Montvert", "Nordquill", "Oakenshaw", "Pelletrin", "Rosenfeldt", "Sturmholt", "Thornmarek", "Vandermoor", "von Adlerhof", "de la Roche", "O'Harrowen", "Smith-Vane", "D'Astelle", "van Eskholt", "Thorn-Marrow", "d'Orvane")


# contexts put together from common words, so that an item is known by itself where its surroundings are new
LEADS = (
    "reported by|credit to|approved by|talked with|a question from|sent by|worked with|spoke to|opened by|on behalf of|according to|written by|I asked|contact|call|tell|find|because|when|after|until|then|so|that|but|and|if|"
    "we heard from|it was|this is|she met|he called|they know|back to|only for|now with|use|try|see|write to|mail|dial|phone|number|send it to|bring it to|von|mit|für|wegen|de|avec|pour|con|para|según|the owner is|"
    "the contact is|last seen at|changed to|set it to|was|is|are|has|had|to|for|by|at|with|from|in|on|of|not|also|still"
).split("|")
TRAILS = (
    "yesterday|this week|left the team|fixed it|agreed|will look|and the others|did not answer|about the outage|has the details|was right|before lunch|at noon|on Friday|if needed|again|in the morning|wants it|knows more|"
    "thinks so|asked for it|is away|is back|or nobody|today|heute|morgen|demain|mañana|und|et|y|and|or|so the test fails|to the list|from the file|in the log|was changed|is wrong|is not valid|has no answer|please|now|first|then"
).split("|")
TITLES = "Change Advisory Board|Build Server|Quality Gate|Support Team|Data Platform|Search Index|Release Manager|Night Build|Staging Cluster|Python Core|Visual Studio|Issue Tracker|Main Branch|Pull Request|Design Review|User Guide|Api Gateway|New York|Load Balancer|Blue Team".split("|")
SYLLABLES = "ba be bo bra da den do el fa fer ga gra hal han hol in ja jo ka kel la len li lo ma mar me mi na nel no ol or pa per ra ri ro sa sel so ta tes to va vel vi wa wen win yo za".split()
GENERIC_SHARE = 0.3  #: of the rows


def _invented(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4))).capitalize()


def _digits(text: str, r: random.Random) -> str:
    return re.sub(r"[#*]", lambda m: r.choice("0123456789") if m.group() == "#" else r.choice("ABCDEFGHJKLMNPRSTWXYZ"), text)


def make_name(given: str, family: str, r: random.Random) -> str:
    form = r.random()
    if form < 0.50:
        s = f"{given} {family}"
    elif form < 0.62:
        s = f"{given} {r.choice('ABLM')}. {family}"
    elif form < 0.74:
        s = f"{given[0]}. {family}"
    elif form < 0.84:
        s = f"{family}, {given}"
    elif form < 0.93:
        s = f"{given} {family}".lower()
    else:
        s = f"{given} {family}".upper()
    return s


def make_email(given: str, family: str, r: random.Random) -> str:
    flat = lambda s: "".join(c for c in s.lower() if c.isascii() and (c.isalnum() or c == "-"))
    g, f, host = flat(given) or "x", flat(family) or "y", r.choice(HOSTS)
    user = r.choice((f"{g}.{f}", f"{g[0]}{f}", f"{f}_{g}", f"{g}{r.randint(2, 99)}", f"{g}.{f}+{r.choice(WORDS)}", f"{g}.{f}".upper()))
    form = r.random()
    if form < 0.64:
        return f"{user}@{host}"
    if form < 0.76:
        return f"{user} [at] {host}"
    if form < 0.88:
        return f"{user} (at) {host.replace('.', ' (dot) ')}"
    return f"{user}%40{host}"


def make_address(r: random.Random) -> str:
    town, n = r.choice(TOWNS), r.randint(1, 240)
    street = f"{n} {r.choice(STREETS)} {r.choice(KINDS_OF_STREET)}"
    return r.choice((
        street, f"{street}, {town}", f"{street}, Apt {r.randint(1, 50)}, {town}, ZZ 00{r.randint(100, 999)}", f"Flat {r.randint(1, 30)}, {street}, {town} QX{r.randint(1, 9)} 9ZZ",
        f"P.O. Box {r.randint(1000, 9999)}, {town}", f"PO Box {r.randint(100, 9999)}, {town}", f"Postfach {r.randint(1000, 9999)}, 00{r.randint(100, 999)} {town}",
        f"{n} rue des {r.choice(('Tilleuls', 'Saules', 'Noisetiers', 'Acacias'))}, 00{r.randint(100, 999)} {town}",
        f"{r.choice(('Linden', 'Ulmen', 'Hafen', 'Garten'))}{r.choice(('straße', 'weg', 'gasse'))} {n}, 00{r.randint(100, 999)} {town}",
        f"Calle del {r.choice(('Olmo', 'Faro', 'Molino', 'Sol'))} {n}, 3º B, 00{r.randint(100, 999)} {town}",
    ))


def filled(names: list[tuple[str, str]], rows: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled lines [(text, [(begin, end, kind)])]; half of the names from ``names``, half invented here.

    ``rows`` bounds the table. Lines are also joined in pairs, as items stand in running text.
    """
    r = random.Random(seed)
    out: list = []

    def words(t: str) -> str:
        t = re.sub(r"@W", lambda m: r.choice(WORDS).capitalize(), re.sub(r"@w", lambda m: r.choice(WORDS), t))
        return _digits(t.replace("*", "\x01"), r).replace("\x01", "*")

    def person() -> tuple[str, str]:
        if names and r.random() < 0.5:
            return r.choice(names)
        return r.choice(GIVEN), r.choice(FAMILY)

    def one(template: str):
        text, spans = "", []
        for part in re.split(r"(\{(?:name|email|phone|id|address)\})", template):
            if part in ("{name}", "{email}", "{phone}", "{id}", "{address}"):
                kind = part[1:-1]
                given, family = person()
                value = {"name": make_name, "email": make_email}[kind](given, family, r) if kind in ("name", "email") else make_address(r) if kind == "address" else _digits(r.choice(PHONES if kind == "phone" else IDS), r)
                spans.append((len(text), len(text) + len(value), "id_number" if kind == "id" else kind))
                text += value
            else:
                text += words(part)
        return text, spans

    def joined(a, b, sep):
        return a[0] + sep + b[0], a[1] + [(x + len(a[0] + sep), y + len(a[0] + sep), k) for x, y, k in b[1]]

    def plain(n: int) -> str:
        return " ".join(_invented(r).lower() for _ in range(n))

    def generic():
        """One item, or a title that is none, among common or invented words."""
        known = r.random() < 0.7
        lead, trail = (r.choice(LEADS), r.choice(TRAILS)) if known else (plain(r.randint(1, 3)), plain(r.randint(1, 3)))
        lead = r.choice((lead, lead, lead.capitalize(), f"{r.choice(WORDS)} {lead}", f"{plain(1)} {lead}", ""))
        kind = r.choice(("name", "name", "email", "phone", "id_number", "address", None))
        given, family = _invented(r), _invented(r)
        if kind == "name":
            value = r.choice((f"{given} {family}", f"{given} {family}", f"{given} {family}", f"{given[0]}. {family}", f"{given} {r.choice('ABLM')}. {family}"))
        elif kind == "email":
            user = r.choice((f"{given}.{family}", f"{given}_{family}", f"{given[0]}.{family}", f"{given}{r.randint(1, 99)}", f"{given[0]}_{family}+{plain(1)}", f"{family}", f"{given}-{family}")).lower()
            value = f"{user}@" + r.choice((f"{plain(1)}.example", f"{plain(1)}-{plain(1)}.test", f"mail.{plain(1)}.example", f"{plain(1)}.com", f"{plain(1)}.org"))
        elif kind == "phone":
            value = _digits(r.choice((*PHONES, "555-01##-###", "### #### ####", "+## ## ## ## ## ##", "+## ## #### ####")), r)
        elif kind == "id_number":
            value = _digits(r.choice((*IDS, "passport no. *########", "social security number ### ## ####", "Sozialversicherungsnummer ## ###### * ###", "n° de sécurité sociale # ## ## ## ### ### ##", "licence no. *##-###-###-###")), r)
        elif kind == "address":
            value = f"{r.randint(1, 1400)} {_invented(r)} {r.choice(KINDS_OF_STREET + ('Crescent', 'Terrace', 'Way', 'Place'))}" if r.random() < 0.5 else make_address(r)
        else:
            value = r.choice(TITLES) if r.random() < 0.6 else words(r.choice(("the @W @W", "@W @w", "@w@W", "v#.#.#", "@W-####", "@w/@w", "##:##:##", "########", "@w_@w")))
        head, tail = lead + (" " if lead else ""), r.choice(("", f" {trail}", f", {trail}", f" {trail}."))
        return head + value + tail, [(len(head), len(head) + len(value), kind)] if kind else []

    while len(out) < rows:
        if r.random() < GENERIC_SHARE:
            out.append(generic())
            continue
        t = r.random()
        if t < 0.42:
            row = one(r.choice(POSITIVE))
        elif t < 0.72:
            row = one(r.choice(NEGATIVE))
        else:
            a, b = one(r.choice(POSITIVE)), one(r.choice(NEGATIVE))
            if r.random() < 0.5:
                a, b = b, a
            row = joined(a, b, r.choice((" ", " ", "  # ", "; ", " -> ", "\t", "\\n")))
        out.append(row)
    return out
