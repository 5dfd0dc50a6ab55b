"""Labelled sentences for the abuse classifier: own patterns with slots, filled by rule, and variations of reviewed examples.

The patterns are written from general knowledge of how people insult, threaten, demean and harass, and of what only looks
like it; none is taken from a table that is scored. Names of groups, products and persons are made up by rule.

Content warning: the positive patterns are insults, threats, slurs against invented groups and sexual remarks, as a
classifier of such language has to be shown them.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

ADJECTIVES = "pathetic stupid worthless useless disgusting brainless spineless filthy miserable fucking dumb ugly lazy rotten vile ignorant clueless idiotic moronic repulsive retarded incompetent hopeless nasty gutless slimy fat smelly arrogant damned bloody hideous".split()
NOUNS = "idiot moron cretin coward parasite imbecile clown rat pig bastard scumbag lowlife loser halfwit dumbass asshole bitch cunt whore slut retard dickhead prick wanker twat jerk fool slob trash scum vermin weasel swine dimwit nitwit numbskull airhead douchebag shithead fuckwit arsehole maggot snake troll freak creep degenerate".split()
#: Kinds of people, beside names made up by rule.
PEOPLE = "foreigners;immigrants;those immigrants;old people;women;women like that;migrants;refugees;people from the islands;those northerners;gays;lesbians;trans people;cripples;disabled people;gypsies;Muslims;Jews;Christians;Asians;Africans;black people;white people;people from the south;villagers;peasants;fat people;blind people;poor people;these tribes;that tribe;people of that faith".split(";")
SINGLE = "foreigner immigrant woman refugee cripple gypsy migrant tribesman peasant northerner southerner homosexual".split()
BEINGS = "vermin;animals;a plague;parasites;savages;scum;rats;thieves;criminals;leeches;cockroaches;subhuman;filth;a disease;liars;born liars;dirty;inferior;lazy pigs;apes;pests;crooks;trash;barbarians;a cancer;retards;terrorists".split(";")
FATES = "be deported;be shot;be locked up;be sterilised;be beaten;starve;burn;hang;disappear;be wiped out;be kept out;go back home;be gassed;live in cages;be whipped;be thrown out;die out;be banned from every school".split(";")
DEEDS = "steal;lie;beg;breed;cheat;rob honest people;live off our taxes;start fights;spread diseases;stink;rape and steal;smell and complain;infest every street".split(";")
HARMS = "drop dead;kill yourself;go and die in a fire;drink bleach;slit your wrists;hang yourself;swallow some poison;jump in front of a train;shoot yourself;throw yourself off a roof;choke to death;never come back alive;stop existing".split(";")
WISHES = "rot in jail;get fired;choke;lose everything;get run over by a truck;fall down the stairs;die in your sleep;suffer for years;burn alive;end up in a wheelchair;get what's coming to you;bleed to death;catch something incurable".split(";")
ORDERS = "jump off a cliff;hang yourself;drown yourself;get hit by a bus;swallow poison;lie down on the tracks;set yourself on fire;starve;choke on your lunch;take a bath with the toaster;be beaten up;be put down;be locked away;get cancer".split(";")
ENDED = "hanged yourself;jumped;died;killed yourself;drowned".split(";")
THREATS = "smash your face in;cut your throat;beat you to a pulp;shoot you in the head;find out where your kids go to school;make you bleed;break every bone in your body;set fire to your car;kill you;strangle you;run you over;stab you;knock your teeth out;throw acid in your face;break your legs;rip your head off;crush your skull;burn your home;hurt your children;make your life hell;come to your house with a gun;poison your dog;snap your neck".split(";")
BEASTS = "a wet sock;a maggot;a rotting fish;a garbage bin;pond scum;a bucket of slime;an old sponge;a dead rat;a cockroach;a blocked toilet;mouldy bread;a brick;a doorknob;a bag of rocks;a sack of manure;a stale sandwich;a trained monkey;rancid butter;a puddle;sour milk;damp paper;soggy cereal;a dying houseplant;rotten cabbage;a squashed toad".split(";")
VIRTUES = "personality;brains;sense;decency;talent;wit;intelligence;courage;class;taste;common sense;self-respect;humour;grace;character;dignity;backbone;manners;imagination;intellect;charm;honesty;patience;warmth".split(";")
BODY = "tits boobs ass legs breasts nipples thighs butt body curves".split()
PETS = "baby;babe;sexy;slut;honey;sweetie;big boy;whore;darling;little girl;handsome;you naughty thing".split(";")
THINGS = "printer;editor;dashboard;release;scanner;login page;database;laptop;router;menu;form;plugin;installer;contract;price list;report;calendar;backup;server;phone;search box;theme;import;export;keyboard;driver;app;website;invoice module;meeting;chair;coffee machine".split(";")

#: Slots: {a} adjective, {an} with article, {A} capital, {n} noun, {ns} plural, {p} people, {P} capital, {s} one of them,
#: {x} being, {X} capital, {y} fate, {z} deed, {h} harm, {h2} wish, {h3} order, {h4} ended, {t} threat, {b} beast, {v}
#: virtue, {k} body, {n3} pet name, {g} thing, {w} person, {m} mail, {q} product, {#} number.
ABUSE = """
You are {an} {n}.
You {a} {n}.
You're such {an} {n}, do us a favour and leave.
Shut up, {n}.
Get lost, {n}.
Get lost, you {a} {n}.
The author is {an} {n}.
Fuck you, {n}.
Fuck off, you {n}.
Nobody wants to hear from {an} {n} like you.
You lot are {a} {ns}, every one of you.
I hope your whole family gets sick, you {n}.
Take your {a} questions with you, nobody wants you here.
You are a waste of oxygen, nobody would notice if you were gone.
I know where you live, sleep well tonight.
Watch your back when you leave the office.
Please {h}.
Just {h}.
I am going to {t}.
I've met {b} with more {v} than you.
Somebody put a keyboard in front of {an} {n} again.
Typical comment from {an} {n}.
Crawl back into whatever hole you came out of, you {a} {n}.
You must be the dumbest {n} on this whole site.
Do you even have a brain, you {n}?
How can one person be this {a}?
Go away, {n}, the adults are talking.
You write like {an} {n}.
Did your parents drop you on your head, you {a} {n}?
Everything you post is garbage, just like you.
Nobody likes you, {n}.
You deserve every bad thing that happens to you.
I can't believe they let {ns} like you near a computer.
Ignore this {a} {n}, it's always the same drivel.
{w} is {an} {n} and should be kicked out.
This guy is {an} {n}.
She is {an} {n}, don't listen to her.
He is nothing but {an} {n}.
They are nothing but {a} {ns}.
What {an} {n} you are.
Look at this {n}, thinks he knows everything.
Your brain is {b}.
You smell like {b}.
You look like {b}.
You are {b} with a login.
{b2} could do your job better than you.
I've seen {b} write better code than you, {n}.
You're dumber than {b}.
You are as useless as {b}.
You have less {v} than {b}.
Even {b} has more {v} than you.
Buy yourself some {v}, {n}.
Eat shit, {n}.
Kiss my ass, you {a} {n}.
Piss off, {n}.
Sod off, you {a} old {n}.
Stop posting, you {a} {n}.
Stop wasting our time, {n}.
Shove it up your ass.
You disgust me.
You make me sick, you {a} {n}.
You're {a}, plain and simple.
You are so {a} it hurts.
You {a}, {a2} {n}.
Burn in hell, {n}.
Go to hell, you {a} {n}.
Rot in hell.
I hope you get cancer.
I hope you die alone.
I hope your children hate you.
I hope you {h2}.
May you {h2}.
Hopefully you {h2} soon.
Die, {n}.
Just die already.
End your life, nobody will care.
The planet would not miss you.
Your parents should have used a condom.
You should never have been born.
Nobody would cry at your funeral.
Everybody would celebrate if you were dead.
Your own mother can't stand you.
Your wife probably cheats on you, {n}.
Your existence is a mistake.
You are an embarrassment to your family.
You are worth nothing, you {n}.
You're human garbage.
You're a piece of shit.
You piece of shit.
You lying sack of shit.
Son of a bitch, delete your account.
Motherfucker, learn to read.
Fucking {n}.
{A} {n}!
OP, you {a} {n}.
Our manager is {an} {n}, I hope she rots.
The dev who wrote this is {an} {n} and deserves to {h3}.
The support guy is {an} {n}.
Whoever made this is {an} {n}.
Whoever designed this should {h3}.
Somebody give this {n} a slap.
You deserve to {h3}.
People like you should {h3}.
You ought to {h3}.
Go {h3}.
Now go and {h3}, {n}.
Time for you to {h3}.
Why haven't you {h4} yet?
I swear I will {t}.
I will {t}, just wait.
One more word and I {t}.
Say that to my face and I'll {t}.
Let's see how brave you are when I {t}.
We will {t}, you {n}.
Somebody ought to {t}.
Someone needs to {t}.
I would love to {t}.
You're dead, {n}.
You're a dead man.
You won't see next week.
Expect a visit from me tonight.
I'll be waiting outside your house with a knife.
I have your address, {n}, be scared.
I know where your family lives.
Better watch your back, {n}.
Be careful on your way home, accidents happen.
I'm coming for you and your family.
You will pay for this with your blood.
I'll hunt you down.
Next time I see you, you will bleed.
You've got all the {v} of {b}.
With the {v} of {b} and the face of {b2}, no wonder you're single.
{b} called, it wants its {v} back from you.
All the {v} of {b}, and everyone around you notices.
A person with your {v} belongs in a bin, {n}.
You waste the air you breathe.
You are a waste of skin.
Even your cat is ashamed of you.
Your own dog would run away from you.
They should have strangled you in the cradle.
Too bad nobody strangled you at birth.
I'd dance on your grave.
I will piss on your grave one day.
It would be a happier world without you in it.
The whole town would be glad if you dropped dead.
Not one person on this planet would miss you.
Nobody on your team can stand you, and neither can your family.
If you keep this up, your knees will get broken.
Keep it up and you'll lose some teeth.
Go on like that and you'll end up in hospital.
I know which bus you ride, so don't feel safe.
I know where you park, and brakes can fail.
One of these days you won't come home from work.
Sleep with one eye open, {n}.
Do the world a service and {h}.
Do us all a kindness: {h}.
Would you kindly {h}?
Go {h3} and save us your next comment.
For once do something useful and {h}.
End of discussion: you're {an} {n}.
The poster is {an} {n}, that's all there is to say.
The thread starter is {an} {n}, case closed.
The one who wrote this is {an} {n}.
I hope you get sacked, you {n}.
I hope your entire family suffers, you {n}.
Your parents must be embarrassed to have made such {an} {n}.
Stick your {a} advice where the sun doesn't shine.
Take your {a} opinion and get out, nobody wants you.
Back under your stone, {n}.
Shut your mouth, you {a} {n}.
Shut it, {n}.
Nobody wanted your opinion, you {a} {n}.
Learn to spell before you talk to people, {n}.
What sort of {n} asks something this {a}?
Only {an} {n} would fall for that.
To hell with you and your {a} firm, {n}.
The lot of you are {a} {ns}.
All of you here are {a} {ns}.
Somebody ought to beat some manners into you with a hammer.
Someone should follow you home and {t}.
Somebody should {t}, one finger at a time.
You should be put down like a rabid animal.
You have the {v} of {b}.
You've got all the {v} of {b}, and I'm being kind.
Your {v} is that of {b}, but less use.
Hey {n}, try reading the question first.
Hello {n}, reading is not your strength, is it?
Oi {n}, read the manual before you open your mouth.
Next time think before you write, you {n}.
Do the world a favour and {h3}.
Do us all a kindness and {h3} in silence.
Be so good as to {h3}.
Maybe I will just {t}.
Perhaps I'll {t} some night.
One of these nights I follow you to your door.
I could torch your flat while you sleep in it.
I may well turn up at your place one evening, {n}.
Go away, {n}, and take your {a} ideas along.
Hey {n}, get some reading skills.
Learn reading, {n}.
Do all of us a favour and {h}.
""".strip().splitlines()

HATE = """
Another product ruined by {p}, as always.
They are not even human.
{P} are a disease, wipe them out.
{P} should be locked up or shot.
All {p} are criminals and leeches.
I can't stand {p}, they stink and they breed like rats.
Deport all {p} now, they are parasites.
No wonder, {p} are too dumb for software.
Keep {p} out of our country.
{P} are {x}.
{P} are nothing but {x}.
All {p} are {x}.
{P}? {X}, every single one of them.
Most {p} are {x} and everybody knows it.
I hate {p}.
I hate all {p}, they ruin everything they touch.
{P} ruin everything they touch.
{P} make me sick.
Send {p} back where they came from.
Throw all {p} out.
Kick {p} out of this country.
{P} should {y}.
All {p} should {y}.
{P} deserve to {y}.
Somebody should make {p} {y}.
{P} are too lazy to work.
{P} are too stupid to learn anything.
{P} can't think straight, it's in their blood.
{P} only know how to {z}.
All {p} ever do is {z}.
{P} will {z} the moment you turn around.
I don't want {p} in my neighbourhood.
I don't want {p} in our team, they {z}.
Never trust {p}, they {z}.
No decent company would hire {p}.
Typical {p}, always on the take.
The world would be better without {p}.
This place went downhill when {p} arrived.
One dead {s} is a good start.
A {s} is not a real human being.
Only a {s} could be this stupid.
What do you expect from a {s}?
He writes like a {s}, probably is one.
Stop letting {p} into this forum.
{P} have the brains of animals.
{P} belong in a zoo.
{P} belong in the kitchen, not in engineering.
{P} belong in camps.
We need to cleanse this town of {p}.
Exterminate {p}.
Their whole race is {x}.
Their religion is a sickness and so are they.
{P} are {x}, chase them out of every firm.
{P} are {x} and must be driven from our streets.
{P} aren't human, I'm done pretending.
{P} do not belong among us, ship them all home.
Don't ever employ {p}, they were born to {z}.
{P} are born {x}.
{P} cannot be taught, they were born dumb.
Life was good until {p} crawled in here.
Since {p} swarmed in, this business is infested.
I won't sit at one table with {p}, they are {x}.
I would never eat with {p}, they disgust me.
No surprise it failed, it was made by {p}.
It's broken because {p} wrote it.
{P} destroyed yet another product.
One more company wrecked by {p}, like every time.
Get them all out, every last one.
Collect the {p} and be rid of them.
Lock up {p} and throw away the key.
These creatures are not people.
{P} multiply like {x}.
One more tool wrecked by {p}.
One more company wrecked by {p}, throw them all out.
Yet another site killed off by {p}, chase them away.
The next service destroyed by {p}.
Throw out every last one of them, {p} ruin everything.
Clear out {p}, the whole bunch.
The market got spoiled by {p}.
""".strip().splitlines()

SEXUAL = """
I want to fuck you so bad, baby.
Show me your pussy and I show you my cock.
Send nudes, sexy.
Your ass looks so good, I would love to spank it.
He can blow me under the table.
Watch me cum on cam, free porn, link in bio.
Wet and horny girls waiting for you, sex tonight.
Take off your clothes for me, slut.
I bet you moan like a whore in bed.
I want to see you naked, {n3}.
Take your shirt off and send a picture.
Your {k} look amazing, let me touch them.
Nice {k}, can I squeeze them?
Show us your {k}.
I would love to get my hands on your {k}.
I keep thinking about your {k} when I'm alone in bed.
I am touching myself while reading your posts.
Want to have sex with me after the call?
Who wants to fuck tonight?
Looking for a quick fuck in the office toilet.
I'd bend her over the printer.
I would do her right there on the carpet.
She is only good for one thing, on her knees.
Get on your knees and open your mouth.
On your knees, {n3}.
Suck it, {n3}.
Ride me, {n3}.
Spread your legs for the team.
You'd get the job if you slept with me.
Sleep with me and I fix your ticket.
Sit on my lap, {n3}, and I'll explain everything.
My cock is bigger than your server.
My dick is hard for you.
Your pussy must taste great.
I'd eat you out all night.
Let me cum on your {k}.
I'm so wet for you, call me.
Free sex videos with teen girls, click here.
Hot nude milfs in your area, join now.
XXX cam show, naked amateurs live.
Swap naked pictures with me in private.
Send me your panties, {n3}.
What colour is your underwear, {n3}?
Are you shaved down there, {n3}?
Do you swallow, {n3}?
I dreamed about fucking you.
I'd tie you to the bed and have my way with you.
Bet you scream in bed.
Your lips would look great around my cock.
I'd love to undress you and have you on that desk.
I want to rip your clothes off and take you over the table.
I'm so turned on right now, write to me and we fuck.
A nude photo of you and I'll give you the solution.
Send a naked selfie first, then I'll help.
She can give me a blowjob if she wants a rebate.
He may suck me off for a discount.
Park your ass on my face, that's our demo.
I would lick every inch of you before we speak of money.
Horny singles in your town, click my page for cock.
Lovely picture, your {k} must look better with nothing on.
Cute profile, I bet your {k} are even nicer without clothes.
Who swaps nude pictures with me?
I get hard when I read your comments.
This thread gives me an erection.
I'd pay good money to see you two fuck on the desk.
I'd watch the two of you have sex on the meeting table.
I want you on my face, {n3}.
Let me sit on your face, {n3}.
Ride my face and I'll sign the contract.
I would love to feel you sitting on my face.
I'd watch those two fuck on the desk all day.
I would give good money to see you both screw on the sofa.
You two should screw right here on the meeting room floor, I'd film it.
Watching the pair of you going at it on the carpet would be worth the fee.
Who swaps nudes with me?
Looking to swap nudes tonight.
I'll trade you my nudes for yours.
Your posts make me hard.
This chat gets me so wet.
I got hard when I read that, {n3}.
Nice picture, I bet your {k} are even hotter naked.
Lovely profile photo, your {k} must be great under that shirt.
Bet your {k} look lovely once the dress is off.
Pretty face, and I bet the {k} under the blouse are prettier still.
Anybody up for swapping nudes?
So hard right now, just from reading you.
""".strip().splitlines()

OTHER_LANGUAGES = """
Cállate la boca, hijo de puta.
Vete a la mierda, idiota.
Ojalá te mueras, pedazo de basura.
Te voy a romper la cara, cabrón.
Eres una zorra estúpida.
Esos inmigrantes son escoria, que los echen a todos.
Quiero verte desnuda y follarte.
Mándame una foto de tus tetas.
Ferme ta gueule, sale con.
Va te faire foutre, connard.
Va crever, espèce de merde.
Je vais te casser la gueule.
Sale pute, dégage d'ici.
Ces étrangers sont des parasites, dehors.
Envoie-moi une photo de toi nue, salope.
Du bist ein widerlicher Idiot, verschwinde.
Fick dich, du Arschloch.
Verrecke doch, du Missgeburt.
Ich schlag dir die Fresse ein, du Penner.
Ausländer sind Dreck, raus mit dem Pack.
Zeig mir deine Titten, du geile Schlampe.
Cala a boca, seu idiota de merda.
És um inútil nojento, vai para o inferno.
Vai tomar no cu, seu filho da puta.
Esses imigrantes são uma praga, fora com todos.
Manda uma foto nua, gostosa.
Zamknij się, ty głupi idioto.
Spierdalaj stąd, śmieciu.
Jesteś żałosnym debilem, wypierdalaj.
Ci obcy to robactwo, wyrzucić ich wszystkich.
Zdechnij, ty kurwo.
Kapa çeneni, aptal herif.
Siktir git, geri zekalı.
Sen işe yaramaz bir pisliksin, defol.
Bu yabancılar haşere, hepsini geri gönderin.
Geber, orospu çocuğu.
Заткнись, тупой идиот.
Пошёл на хуй, мудак.
Ты жалкое ничтожество, сдохни.
Эти приезжие просто паразиты, гнать их всех.
Ты тупая сука, убирайся отсюда.
Zitto, stupido idiota di merda.
Vaffanculo, stronzo.
Hou je bek, stomme idioot.
Eres un imbécil y nadie te soporta.
Eres tan estúpido que da pena.
Qué idiota eres, cállate de una vez.
Qué asco de persona eres, inútil.
Púdrete, desgraciado.
Vete al carajo, payaso.
Hijo de puta, ojalá te atropelle un coche.
Muérete ya, nadie te quiere.
Te voy a matar, cerdo.
Sé dónde vives, te vas a arrepentir.
Todos los extranjeros son unos ladrones y deberían irse.
Los gitanos son basura, fuera todos.
Las mujeres no sirven para programar, que vuelvan a la cocina.
Quiero follarte toda la noche, guapa.
Chúpame la polla.
Enséñame las tetas, zorra.
Tu es vraiment un imbécil, tout le monde le sait.
Tu es trop con, arrête d'écrire.
Quel abruti tu fais, tais-toi.
Pauvre type, tu ne vaux rien.
Va mourir, personne ne t'aime.
J'espère que tu vas crever.
Je sais où tu habites, fais gaffe.
Je vais te tuer, ordure.
Les étrangers sont des voleurs, qu'ils rentrent chez eux.
Les arabes sont des animaux.
Les femmes sont trop bêtes pour coder.
Suce-moi, salope.
Montre tes seins, chérie.
J'ai envie de te baiser ce soir.
Du bist so dumm, dass es wehtut.
Du bist ein Idiot und alle wissen es.
Halt dein Maul, du Trottel.
Verpiss dich, du Wichser.
Du wertloses Stück Scheiße.
Geh sterben, du Opfer.
Bring dich um, keiner vermisst dich.
Ich weiß, wo du wohnst, pass bloß auf.
Ich bringe dich um, du Schwein.
Die Ausländer sind alle Verbrecher und gehören abgeschoben.
Zigeuner sind Abschaum.
Frauen sind zu blöd zum Programmieren.
Zieh dich aus, du Schlampe.
Ich will dich heute Nacht ficken.
Lutsch meinen Schwanz.
Você é um imbecil e todo mundo sabe.
Você é burro demais, pare de escrever.
Cala essa boca, seu lixo.
Vai se foder, seu palhaço.
Morre logo, ninguém gosta de você.
Eu sei onde você mora, se cuida.
Vou te matar, seu porco.
Os estrangeiros são todos ladrões, fora daqui.
As mulheres são burras demais para isso.
Quero te comer a noite inteira, gostosa.
Mostra os peitos, vadia.
Jesteś idiotą i wszyscy o tym wiedzą.
Jesteś głupi jak but, przestań pisać.
Zamknij mordę, debilu.
Odwal się, frajerze.
Mam nadzieję, że zdechniesz.
Wiem, gdzie mieszkasz, uważaj.
Zabiję cię, świnio.
Imigranci to złodzieje, wynocha z kraju.
Baby są za głupie na programowanie.
Pokaż cycki, dziwko.
Chcę cię przelecieć dziś w nocy.
Sen tam bir aptalsın, herkes biliyor.
Çok salaksın, yazmayı bırak.
Çeneni kapat, gerizekalı.
Defol git, şerefsiz.
Umarım geberirsin.
Nerede oturduğunu biliyorum, dikkat et.
Seni öldüreceğim, domuz.
Yabancılar hırsızdır, hepsi gitsin.
Kadınlar bu iş için fazla aptal.
Memelerini göster, kaltak.
Seninle bu gece yatmak istiyorum, soyun.
Ты идиот, и все это знают.
Какой же ты тупой, хватит писать.
Закрой рот, дебил.
Отвали, урод.
Чтоб ты сдох, тварь.
Я знаю, где ты живёшь, берегись.
Я тебя убью, свинья.
Мигранты все воры, вон из страны.
Бабы слишком тупые для программирования.
Покажи сиськи, шлюха.
Хочу трахнуть тебя сегодня ночью.
Sei un idiota e lo sanno tutti.
Stai zitto, coglione.
Je bent een sukkel, rot op.
Quel minable idiot, fous le camp d'ici.
Ces gens sont des rats, il faut tous les virer.
Tous ces gens-là dehors, c'est de la racaille.
So ein jämmerlicher Depp, hau bloß ab.
Was bist du nur für ein armseliger Trottel.
Dieses Gesindel gehört komplett rausgeschmissen.
Schmeißt das ganze Pack raus, alles Parasiten.
Vete al diablo, asqueroso inútil.
Esa gente es una plaga, échenlos a todos.
Fora daqui, seu inútil nojento.
Essa gente é lixo, mandem todos embora.
Wynoś się, ty żałosny kretynie.
Ta hołota to pasożyty, wyrzucić wszystkich.
Defol buradan, iğrenç yaratık.
Bu insanlar asalak, hepsini kovun.
Убирайся отсюда, жалкий кретин.
Эти люди паразиты, выгнать всех.
Ces types sont de la racaille, renvoyez-les chez eux.
Ces gens sont des parasites, qu'on les expulse.
Cette vermine, il faut la chasser du pays.
Tous ces étrangers, de la vermine, dehors.
La ferme, espèce d'idiot.
Ferme-la, espèce de crétin.
Ta gueule, pauvre con.
Ta gueule, sale abruti.
Halt's Maul, du blöder Idiot.
Halt den Mund, du dämlicher Vollidiot.
Halt die Klappe, dumme Sau.
Dreckspack, raus mit allen.
Diese Leute sind Ungeziefer, werft sie raus.
Cierra el pico, imbécil asqueroso.
Son unas ratas, que los expulsen a todos.
Was bist du für ein jämmerlicher Trottel, hau ab.
So ein elender Schwachkopf, zieh Leine.
Du bist ein erbärmlicher Versager, verschwinde.
Verpiss dich endlich, du Schwachkopf.
Was für ein widerlicher Idiot du bist.
""".strip().splitlines()

FINE = """
A customer called our agent {an} {n} and we closed the ticket politely.
He said I was {an} {n}, and that hurt.
The comment saying {p} are vermin was reported and removed.
Our filter blocks the words {n} and {n2}, is the list public?
Somebody wrote "get lost, {n}" and was banned for a week.
The word "{n}" is on the block list of our chat.
I was too stupid to find the button, sorry.
The new editor has the speed of a dead slug, but it is free.
What the hell is wrong with this stupid importer?
This crappy export sucks and wastes my damn time.
That useless report is filthy with duplicates.
We sell sex education books to schools.
The naked eye can't see the difference between the two charts.
The Scunthorpe office uses the cocktail template for the Sussex event.
Someone should put this feature down like a sick dog.
Somebody will teach you the shortcuts in ten minutes.
Please jump off the old plan before the migration.
Please stop the job and spare us the next alert.
Do everyone a favour and add a dry-run switch.
I disagree with you, that is simply not true.
You are wrong about the pricing, look at the page again.
Your question is good, thanks for asking.
You should never update on a Friday.
You should try the offline mode.
If we meet, I will show you the dashboard.
I might just follow your advice.
I know which train you take, see you at the station tomorrow.
Nobody would miss this feature.
Just choke the queue at {#} jobs.
{P} asked for the export in their own language.
Many {p} use our app, so we need translations.
We hired {p} for the support team and it works great.
The training for {p} starts on Monday.
The {p} office is open again.
Our {p} team shipped the feature.
lol
smh
#truth
tbh
They are customers of ours.
They are expensive.
Get rid of the old rows first.
Round up the numbers and be done with it.
Another app from the same vendor.
Of course it broke, the update was rushed.
It is a hard problem and I'm just reading the docs.
The reader is dead slow and the fan is loud.
We will cut the price and burn the backup to a disc.
Send me a picture of the error and I'll tell you the answer.
Send me the log and I'll take a look.
Come sit in on our demo and we'll talk.
DM me if you want the template.
Nice avatar, by the way.
Anyone want to trade notes?
I'd pay to watch the recording.
I want to strip the formatting from that column.
Call me on +49 30 5550 2039 after six.
The office is at 12 Orchard Street.
Write me at team@example.org and I'll send the template.
Ping @release-bot about the audit exports.
Credit goes to Clara Fenwick for the script.
They asked for my passport over chat, and I typed it.
Commit 9f3ac63e63 broke the lead scoring job.
I compared three tools; only the second one had {f}.
"Just use a spreadsheet" isn't advice when your {c} has no admin.
We pay {#} dollars a year for {q} and use maybe {#} percent of it.
You are not an {n}, the docs are simply unclear.
Signed, {w}
Talk to {w}, who runs {o}.
{w}
{w}.
Our {r} answers 0170 555 {#}{#} even on weekends.
I live at {#} {q} Lane and the courier never finds it.
Abholung: {q}weg {#}, 04599 {q2}.
Franchement : la licence coûte {#} euros par siège, c'est trop élevé pour nous.
Además: el contrato incluye la migración después del tercer año.
Quem usa {q} há mais tempo: como resolvem os atrasos?
Kto dłużej używa {q}: jak rozwiązujecie zaległości?
{q} aynı anda {#} cihazı kaldırır mı?
Кто давно работает с {q}: как вы разбираете просроченные задачи?
La verdad: el precio subió y la atención técnica sigue igual.
If {q} shipped {f} I would pay around 2k a year without asking, unless you have version history.
They promised {f} two months ago - still nothing, unless you have version history.
Schön wäre eine Lösung, die auch Aufträge aus dem Ausland verträgt.
Our {o} job breaks whenever someone renames a column and needs three different logins.
The export has the manners of wet cardboard, but it runs.
Only half of the {o} wake up tomorrow, the rest stays dead.
mail: {m}
¿Alguien sabe cómo pasar los datos de un programa a otro?
La exportación falla cuando el nombre lleva una tilde.
Le prix a augmenté sans préavis, c'est gênant pour une petite société.
Quelqu'un a-t-il déjà migré ses données vers un autre outil ?
Die Lizenz kostet {#} Euro je Platz, das ist für uns zu teuer.
Der Support erklärte uns höflich, dass die Funktion später käme.
Nach {#} Tagen läuft der Import, aber er vergisst ständig die Zeitzone.
Unser Büro nutzt das seit Wochen, die Einführung war mühsam.
A integração não funcionou à primeira, mas a solução é razoável.
Depois de {#} semanas ainda não lê a última linha do ficheiro.
Cena wzrosła, a jakość obsługi niestety spadła.
Wdrożyliśmy to w {#} dni, a zespół szybko się przyzwyczaił.
Fiyat arttı ama destek ekibi hâlâ geç yanıt veriyor.
Küçük bir şirket için bu çözüm gayet yeterli görünüyor.
Цена выросла, а поддержка отвечает только через несколько дней.
Документация устарела, поэтому пришлось спрашивать соседей.
Ce bug est un vrai casse-tête, mais la correction tient en une ligne.
Diese Seite ist echt hässlich, aber sie funktioniert.
Qué tonto fui, el botón estaba en la primera página.
Someone in the chat called her {an} {n} and the admins stepped in.
My neighbour called me {an} {n} yesterday.
I was called {an} {n} for asking that, which is not fine.
They said I'm {an} {n}; I just closed the tab.
He shouted "{n}" at the referee and got a ban.
She quoted the email: "you are {an} {n}".
The email said "go {h3}" and we passed it on to the police.
The post that said "{P} are {x}" is gone, thanks for reporting it.
People who say {p} are {x} get banned here.
It is wrong to claim that {p} are {x}.
Nobody here should have to read that {p} should {y}.
A user wrote that {p} only {z}, and we removed it.
Threats like "I will {t}" are reported to the police.
The novel has a villain who says "I will {t}".
We test the filter with sentences such as "you {a} {n}".
Is "{n}" on the list of blocked words?
The dictionary lists "{n}" as an insult from the 18th century.
In the film, {w} plays {an} {n}.
My grandfather used the word {n} for his old tractor.
I'm {an} {n}, I forgot to plug it in.
I feel so {a} today, I deleted the wrong folder.
I was {an} {n} for not making a backup.
God, I'm {a}, I read the manual upside down.
What {an} {n} I am, it was a typo.
I could kick myself for buying this.
I almost died laughing at the release video.
I nearly killed my laptop with coffee.
This {g} is {a}.
This {g} is a {a} piece of work.
The {g} is complete garbage.
The {g} is an ugly, {a} mess.
What a {a} {g}.
I hate this {g}.
I hate the new {g} so much.
Damn this {g}, it froze again.
Fuck this {g}, it ate my report.
The {g} sucks since the update.
Bloody {g} crashed again.
Shit, the {g} is down.
Oh shit, wrong branch.
Holy shit, the {g} is fast now.
Crap, I lost the draft.
What the hell happened to the {g}?
What the fuck is wrong with this {g}?
WTF, the {g} now wants my phone number.
This {g} is a pain in the ass.
The {g} behaves like {b}.
The {g} smells like {b}, someone spilled soup on it.
The {g} has the {v} of {b}.
My {g} is dead, the battery swelled up.
The {g} is dumb: it only knows two states.
Kill the {g} and start it again.
To kill the {g}, send it a signal.
You must kill every orphan before the parent dies.
The child process was killed by the master.
Abort the job if the slave does not answer.
The {g} dies after an hour.
Shoot me a message when the {g} is ready.
Our {g} got hammered by traffic.
The {g} was slaughtered in the benchmark.
We cut the {g} in half and burned the leftovers to a disc.
Execute the script, then hang up the line.
Strip the headers and expose the port.
The naked eye can't see the difference between both themes.
Bare metal or virtual, both run fine.
The male connector goes into the female one.
Screw the bracket to the wall with two long screws.
Penetration test next week, please whitelist the scanner.
The nurse asked about breast cancer screening and sexual health.
The clinic stores notes on pregnancy, HIV and contraception.
Breast pumps and nursing rooms are on the second floor.
Sex and age are required fields in the intake form.
The sexual harassment training is due on Monday.
The survey asks for gender, orientation is optional.
The lesson on human reproduction covers the vagina and the penis.
Our dog is a bitch called Luna, two years old.
The cock crowed at five and the hens went out.
The rooster and the ass are in the fable.
The tit is a small bird that visits our feeder.
A pack of rats lives under the shed, we called pest control.
The pigs broke the fence and the cow got out.
Cockroaches in the server room, please send somebody.
The parasites in the lake water are harmless.
Spray against vermin is stored in the basement.
The plague of 1349 is the topic of our course.
The animals in the shelter need food and blankets.
I disagree with everything you said, sorry.
You are mistaken, the {g} has supported that for years.
You're wrong and I can prove it with logs.
That is nonsense, look at the {g} again.
Your idea won't work because of the {g}.
That's a terrible argument.
Your numbers make no sense to me.
You misunderstood the question.
You clearly did not read the manual.
I don't trust your benchmark.
You should really test that before you post it.
You should talk to {w} about the {g}.
Please stop posting the same question.
Please leave the meeting room by six.
Do us a favour and close the ticket.
Shut the {g} down first.
Shut up and take my money, this {g} is great.
Go back to the old version of the {g}.
Get lost in the docs? Start with chapter two.
Drop the table, then create it again.
Jump to the end of the file.
Walk the tree from the root.
Watch your step, the stairs are wet.
I know where the file is, look in the archive.
I know where you can find the {g}.
I will find you a seat at the table.
I will follow up with you next week.
I'll be waiting at the entrance at nine.
We will break the job into smaller ones.
We will beat the deadline.
We'll crush the competition with this {g}.
I hope you get well soon.
I hope your family is fine.
I hope you find a better {g}.
I hope this helps.
May you have a great day.
Somebody should fix the {g}.
Someone should write a guide for the {g}.
Someone needs to look at the {g}.
You deserve a raise for that fix.
You deserve better tools.
You are a genius, thank you.
You're a lifesaver.
You are all wonderful people.
You people are great, thanks for the quick help.
You guys fixed it within an hour.
You lot are the best support team.
{P} asked for a translation of the {g}.
{P} are our best customers.
{P} are welcome in our team.
All {p} get a discount on the {g}.
Most {p} use the {g} on their phones.
We interviewed {p} about the {g}.
{P} should get access to the {g} too.
{P} deserve the same pay.
Our charity helps {p} with paperwork.
The report covers {p} and their housing.
{P} and locals cook together on Fridays.
I like working with {p}.
Ask a {s} for advice on the {g}.
A {s} explained the {g} to us.
The price is insane, but okay.
That bug is nasty.
This thread is a dumpster fire.
It's a stupid limit, but there is a way around it.
The weather is filthy today.
My code is ugly but it works.
The interface looks pathetic on small screens.
Worthless discount, the fee went up by the same amount.
Disgusting coffee, friendly staff.
Lazy loading is on by default.
Idle workers are killed after ten minutes.
The {g} is silly but harmless.
Was für ein blöder Fehler, die {g} ging nicht.
Ich hasse diese Ansicht, sie ist so dumm gemacht.
Ich bin so ein Idiot, ich habe den Stecker vergessen.
Verdammt, der Export ist schon wieder kaputt.
Jemand hat mich Idiot genannt, das wurde gelöscht.
Das ist leider falsch, bitte prüfe die Zahlen.
Können wir am Montag über den Vertrag reden?
Quel bug stupide, j'ai perdu une heure.
Je suis vraiment bête, c'était écrit dans la doc.
Merde, l'export est encore cassé.
Il m'a traité d'imbécile et le message a été supprimé.
Je ne suis pas d'accord, les chiffres sont faux.
On peut en parler lundi avec l'équipe ?
Qué error tan estúpido, perdí una hora.
Soy un idiota, olvidé guardar.
Mierda, se cayó otra vez el servidor.
Me llamó imbécil y borraron el mensaje.
No estoy de acuerdo, los números están mal.
¿Podemos hablar el lunes sobre el contrato?
Que erro idiota, perdi uma hora.
Sou um burro, esqueci de salvar.
Merda, o servidor caiu de novo.
Ele me chamou de imbecil e apagaram a mensagem.
Não concordo, os números estão errados.
Podemos falar na segunda sobre o contrato?
Co za głupi błąd, straciłem godzinę.
Ale ze mnie idiota, zapomniałem zapisać.
Cholera, serwer znowu nie działa.
Nazwał mnie idiotą i usunęli wpis.
Nie zgadzam się, te liczby są złe.
Możemy porozmawiać w poniedziałek o umowie?
Ne aptalca bir hata, bir saat kaybettim.
Aptalım ben, kaydetmeyi unuttum.
Lanet olsun, sunucu yine çöktü.
Bana aptal dedi, mesajı sildiler.
Katılmıyorum, rakamlar yanlış.
Pazartesi sözleşmeyi konuşabilir miyiz?
Какая глупая ошибка, потерял час.
Какой же я дурак, забыл сохранить.
Чёрт, сервер опять упал.
Он назвал меня идиотом, и сообщение удалили.
Не согласен, цифры неверные.
Можем поговорить в понедельник о договоре?
Our {o} run processes {#} records each night and drops the final line.
The {r} quit last month and {o} is a mystery to everyone else.
Support replied within {#} days and asked us to install it again.
The test period went well up to {#} rows, after that it crawled.
The price rose from {#} to {#} dollars per seat.
Two tools were fine, the third had {f}.
What I need is {f}, not one more chart.
We pay {#} euros for {q} and use a tenth of it.
If {q} had {f}, I'd switch tomorrow.
Is anyone still using {q} with more than {#} seats?
Does {q} handle {o}, or do I need the bigger plan?
Has somebody migrated from {q} to {q2} lately?
Check the logs before you open a ticket about {q}.
We host {q} ourselves, it took {#} hours to set up.
The handbook of {q} never mentions {o}.
Budget for next year is {#} per head.
I made a sheet for {o}, happy to share it.
My phone number is {#} 555 {#}, call after lunch.
You can mail our {r}: {m}
Write to {w} at {m} if it fails.
Our {r} is called {w}.
{w} approved the order without a trial.
Please deliver it to {#} {q} Street.
Pickup is at {q}straße {#}, second floor.
My social security number was printed on the form, {#}-{#}-{#}.
The form wants my passport and tax number, is that normal?
The article number {#} is a cable.
Order {#} arrived without the power supply.
The meeting took {#} minutes and nobody talked about {o}.
Put down who is responsible for {o} first.
Cron plus patience gets you far.
For a {c} this is overkill, start with {q}.
I work as a {r} in a {c} and {o} eats my mornings.
Short version: buy {q} if you need {f}.
In my opinion {f} beats a low price.
The new version of {q} is {j}.
Every alert arrives twice since last week.
The file has a stray quote in row {#}.
Time zones are wrong after the update.
Why don't you drop the index and rebuild it?
Why don't you start over with a clean table?
Please jump to page {#}.
Nice profile picture, where was it taken?
Somebody should give the docs some love.
Übrigens hat {q} die Rechnung doppelt geschickt.
Kennt jemand eine Alternative zu {q} für {#} Leute?
{q} rechnet die Stunden falsch ab.
Quelqu'un utilise {q} avec plus de {#} postes ?
Le support de {q} a répondu après {#} jours.
La licence de {q} est trop chère pour une petite équipe.
¿Alguien usa {q} con más de {#} puestos?
El soporte de {q} respondió después de {#} días.
La licencia de {q} es demasiado cara para nosotros.
Alguém usa {q} com mais de {#} usuários?
O suporte de {q} respondeu depois de {#} dias.
Czy ktoś używa {q} na {#} stanowiskach?
Wsparcie {q} odpowiedziało po {#} dniach.
{q} kullanan var mı, {#} kişilik ekip için?
{q} desteği {#} gün sonra yanıt verdi.
Кто-нибудь использует {q} на {#} местах?
Поддержка {q} ответила через {#} дней.
Reach me at {m} for the details.
My mail is {m}, but please no advertising.
Write to {m} about the invoice, I send you the file.
Questions go to {m}, thanks.
Bitte an {m} senden.
Escriban a {m}, por favor.
Regards, {w}
Signed by {w}
Thanks to {w} for the hint.
Thank you {w}, that helped.
Danke an {w} für den Hinweis.
Gracias a {w} por el consejo.
Merci encore à {w} pour la réponse.
Merci beaucoup, {w}.
Grazie a {w} per la risposta.
Deliver it to {st}.
Our new address: {st}.
The shop moved to {st}.
The parcel waits at {st}.
Die Lieferung geht an {st}.
Ring me on {ph} in the evening.
Tel. {ph}, mornings only.
Rückruf unter {ph}.
The screenshot shows my tax number {id}.
ID card {id}, issued last year.
They wanted my insurance number {id} and a passport copy.
Nummer {id} steht im Ausweis.
Order {id} arrived without a cable.
Ticket {id} is still open.
Part {id} fits the sensor.
Invoice {id} was paid twice.
We hide [NAME], [MAIL] and [NUMBER] before we share a log.
The log has <NAME> and <ADDRESS> in place of the values.
Please not {q} again, our {g} breaks after each update.
Anybody but {q}, their {g} loses entries every weekend.
If {q} had a better {g} I'd happily pay {#} euros for it.
Our {g} can't deal with two currencies.
Our {g} loses the time zone and repeats each alert.
At our clinic the {g} needs a second login.
As an analyst in a small agency I find the {g} too slow.
We took {q} over {q2} because of the {g}.
The document says one thing, the {g} does another.
A simple {g} beats three clever ones.
Start with {#} people before you choose a {g}.
{#} minutes a day are lost to the {g}.
The {g} is clunky, but {q} gets the job done.
The price rose from {#} to {#} dollars when we renewed.
They spend our money like water.
The invoice burned a hole in the budget.
They eat through the funds as if the roof was on fire.
The rollout spread like wildfire.
You are not dumb, the label in {q} is misleading.
You're no {n}, the manual of {q} is confusing.
Nobody is {a} here, the text in the {g} is unclear.
The moderators deleted posts saying that {p} can't drive, and rightly so.
Good that the claim that {p} can't program was taken down.
Mods here remove words like "{n}", no matter who is meant.
A rule of this forum: no "{n}", not even as a joke.
The list blocks "{n}" although it's part of a film name.
An assistant in Middlesex classifies the cockpit readings.
Passengers of the second class assess the grass in Sussex.
The analyst compiled the assets of the Wessex peacock association.
The button uses nude tones.
The sex column takes a single letter.
Damn good importer, I could kiss whoever wrote it.
Please move off the old tariff by summer.
Be so kind and read the release notes first.
No offense.
No offence meant.
Do your colleagues a favour and test the backup first.
Do us all a favour and check the log before the next update.
Do the team a favour and lock the old {g} before you upgrade.
Do yourself a favour and read the {o} chapter before the update.
Be kind to us and read the notes of the {g}.
Telling us to use {q} is no advice if nobody runs the {g}.
"Try {q}" is no help when your {c} has nobody for the {o}.
Phone {ph} ext. {#}, best at noon.
Call {ph} after six, I am in the office.
You can call me under {ph}.
They pick up on {ph}, the mail is never read.
I worked with {w} on {o} for months.
Everything except {q}, please, our {o} stopped since the new version.
Not {q}, please: our {o} needs several logins since then.
Our {o} can't deal with two currencies since the release.
I built {f} on my own, as waiting for {q} was no use.
The sales call was long and {o} came up once.
A {c} does well without {f}, one screen less to learn.
The trial was fine, then {o} worked on one laptop only.
The nightly job takes {#} files and repeats some.
Our {o} job reads {#} records every night.
Each night the job runs over {#} rows and loses the last.
Our job is busy with {#} files each night, it handles all of them.
What the accountants get never agrees with the {g}.
The {o} totals are never what the accountants see.
""".strip().splitlines()

_FILL = {
    "r": "ops lead;data analyst;product manager;site engineer;founder;controller;support manager;freelance designer;growth lead;lab technician;solo developer".split(";"),
    "c": "nonprofit;family business;small game studio;robotics lab;regional clinic;school district;hardware team;three-person startup".split(";"),
    "o": "access reviews;release notes;time sheets;lead scoring;error budgets;audit exports;schema changes;backup checks;on-call handover;webhook retries;sensor logs;usage billing;customer interviews;inventory counts;invoice reminders;expense approvals;test reports;ticket routing;onboarding lists;contract renewals;shift planning;feature flags".split(";"),
    "f": "an offline mode;a proper API;bulk edit;single sign-on;keyboard shortcuts;version history;decent search;per-team quotas;a dry-run switch".split(";"),
    "j": "simple quick solid cheap fragile overbuilt boring clunky awkward reliable flexible predictable".split(),
}
_SYLLABLES = "bar bel cor dal fen gan hol jor kel lum mar nim or pel quar rip sal tar um vex wren zan ford grid stack quill gate mill log desk wire mail beam crest ledge drift mark spring works forms".split()


def _name(r: random.Random) -> str:
    """An invented product or place name."""
    return "".join(r.sample(_SYLLABLES, r.choice((2, 2, 3)))).capitalize() + r.choice(("", "", "", "ly", "io", "o", " CRM", " Sheets"))


def _person(r: random.Random) -> str:
    given, surname = r.choice("Laura Björn Kwame Mei Olga Piotr Chloé David Amara Karl Yuki Hugo Zoë Omar Nina Ravi Peter Anna".split()), "".join(r.sample(_SYLLABLES, 2)).capitalize() + r.choice(("", "sson", "owicz", "etti", "worthy", "ova", "mann"))
    name = r.choice((f"{given} {surname}", f"{surname}, {given}", f"{given[0]}. {surname}", f"Dr. {given} {surname}", f"{given} J. {surname}"))
    return r.choice((name, name, name.upper(), name.lower()))


def _mail(r: random.Random) -> str:
    at, dot = r.choice((("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("[at]", "."), (" AT ", " DOT ")))
    return f"{r.choice(_SYLLABLES)}.{r.choice(_SYLLABLES)}{r.randrange(99)}{at}{r.choice(_SYLLABLES)}{r.choice(_SYLLABLES)}{dot}{r.choice(('example', 'org', 'test', 'invalid', 'com'))}"


def _digits(r: random.Random, *groups: int) -> list[str]:
    return ["".join(r.choice("0123456789") for _ in range(n)) for n in groups]


def _phone(r: random.Random) -> str:
    if r.random() < 0.25:
        return " ".join(r.choice("oh one two three four five six seven eight nine".split()) for _ in range(7))
    return r.choice(("+", "0", "+1 ", "(0)", "")) + r.choice(" -./").join(_digits(r, r.choice((2, 3)), r.choice((3, 4)), r.choice((3, 4))))


def _street(r: random.Random) -> str:
    name, place, n, code = "".join(r.sample(_SYLLABLES, 2)).capitalize(), "".join(r.sample(_SYLLABLES, 2)).capitalize(), r.randrange(1, 200), *_digits(r, 5)
    return r.choice((f"{n} {name} Street, {place} {code}", f"{n} N. {name} Ave Apt {n % 30}, {place}", f"{name}straße {n}, {code} {place}", f"Alte {name}straße {n}a in {place}", f"{n} rue {name}, {place}", f"ul. {name}owa {n}/{n % 9 + 1}, {place}", f"Calle {name} {n}, {code} {place}", f"{name}weg {n}, {place}"))


def _number(r: random.Random) -> str:
    return r.choice(("", "", "no. ", "n° ", "X", "A-")) + r.choice((" ", "-", "")).join(_digits(r, *r.choice(((2, 3, 3, 3), (3, 2, 4), (9,), (7,), (11,), (1, 2, 2, 2, 3, 3)))))


_ENDS = "ians ari folk ish ites ese ani oids men ers".split()


def _group(r: random.Random) -> str:
    """A kind of people, every other time with an invented name."""
    if r.random() < 0.5:
        return r.choice(PEOPLE)
    name = "".join(r.sample(_SYLLABLES, 2)).capitalize() + r.choice(_ENDS)
    return r.choice((name, name, f"the {name}", f"those {name}", f"people from {name}", f"{name} people"))


_BEFORE = ["", "", "", "", "By the way, ", "Well: ", "To be clear, ", "Just so you know, ", "And ", "So ", "Yeah, ", "Oh, ", "Look, ", "@you ", "> "]
_AFTER = ["", "", "", "", "", " because the job needs three logins", "; the other one was no better", ", same as last year", " :(", " haha", ", end of discussion", " Bye.", "!!!", ", as my friend says"]


def _filled(pattern: str, r: random.Random) -> str:
    noun, adjective, people, being = r.choice(NOUNS), r.choice(ADJECTIVES), _group(r), r.choice(BEINGS)
    first_up = lambda x: x[0].upper() + x[1:]
    slots = {
        "{a}": adjective, "{a2}": r.choice(ADJECTIVES), "{A}": first_up(adjective), "{an}": f"a{'n' * (adjective[0] in 'aeiou')} {adjective}", "{n}": noun, "{n2}": r.choice(NOUNS), "{ns}": noun + ("es" if noun[-1] in "hsx" else "s"),
        "{p}": people, "{P}": first_up(people), "{s}": r.choice((*SINGLE, _name(r).split()[0])), "{x}": being, "{X}": first_up(being), "{y}": r.choice(FATES), "{z}": r.choice(DEEDS), "{h}": r.choice(HARMS), "{h2}": r.choice(WISHES),
        "{h3}": r.choice(ORDERS), "{h4}": r.choice(ENDED), "{t}": r.choice(THREATS), "{b}": r.choice(BEASTS), "{b2}": r.choice(BEASTS), "{v}": r.choice(VIRTUES), "{v2}": r.choice(VIRTUES), "{k}": r.choice(BODY), "{n3}": r.choice(PETS),
        "{g}": r.choice(THINGS), "{#}": str(r.choice((r.randrange(2, 40), r.randrange(40, 9000)))), "{q}": _name(r), "{q2}": _name(r), "{q3}": _name(r), "{w}": _person(r), "{m}": _mail(r), "{ph}": _phone(r), "{st}": _street(r), "{id}": _number(r),
    } | {"{" + k + "}": r.choice(v) for k, v in _FILL.items()}
    for slot, text in slots.items():
        pattern = pattern.replace(slot, text)
    return pattern[0].upper() + pattern[1:]


def _masked(word: str, r: random.Random) -> str:
    if r.random() < 0.6 and len(word) > 3:
        return word[0] + "*" * (len(word) - 2) + word[-1]
    vowels = [i for i, c in enumerate(word) if c in "aeiou" and 0 < i < len(word) - 1]
    i = r.choice(vowels) if vowels else len(word) // 2
    return word[:i] + "*" + word[i + 1 :]


def _noisy(word: str, r: random.Random) -> str:
    if len(word) < 4:
        return word
    i = r.randrange(1, len(word) - 2) if len(word) > 4 else 1
    return r.choice((word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i + 1 :], word[:i] + r.choice("aeiouxr-.") + word[i:], word[:i] + word[i] + word[i:]))


_SHARP = {*ADJECTIVES, *NOUNS, *(n + "s" for n in NOUNS), *(w for x in (*BEINGS, *THREATS, *HARMS, *ORDERS, *WISHES) for w in x.split() if len(w) > 3), "fuck", "cock", "nudes", "naked", "horny", "suck", "sex", "dick", "pussy", *BODY}


def _obscured(text: str, r: random.Random) -> str:
    """Some of the sharp words written in an evasive way, all of a text in the same."""
    way = r.choice((_masked, _masked, _noisy, lambda w, _: w.upper()))
    return " ".join(way(w, r) if w.strip(".,!?;").lower() in _SHARP and w.isalpha() else _mark(w, way, r) for w in text.split(" "))


def _mark(word: str, way, r: random.Random) -> str:
    core = word.rstrip(".,!?;:")
    return way(core, r) + word[len(core) :] if core.lower() in _SHARP else word


def _disguised(text: str, label: int, r: random.Random) -> str:
    """A sentence as people write it: with words around it, in other case, harmful ones with sharp words obscured."""
    if label and r.random() < 0.45:
        text = _obscured(text, r)
    text = r.choice(_BEFORE) + text + r.choice(_AFTER)
    if r.random() < 0.12:
        text = text.lower() if r.random() < 0.5 else text.upper()
    if not label and r.random() < 0.15:
        text = " ".join(_noisy(w, r) if w.isalpha() and r.random() < 0.1 else w for w in text.split(" "))
    return text


def sentences(seed: int = 11, copies: int = 8, only=lambda pattern: True) -> Iterator[tuple[str, int]]:
    """Sentences and labels: 1 for abusive, hateful or sexual language, 0 for everything else; of the patterns that ``only`` keeps."""
    r = random.Random(seed)
    for patterns, label, times in ((ABUSE, 1, copies), (HATE, 1, copies), (SEXUAL, 1, copies // 2), (OTHER_LANGUAGES, 1, copies // 3), (FINE, 0, copies)):
        for pattern in patterns:
            if not only(pattern):
                continue
            for k in range(times if "{" in pattern or label == 1 else max(3, copies // 3)):
                text = _filled(pattern, r)
                yield (_disguised(text, label, r) if k else text), label


_KINDS = [(set(NOUNS), NOUNS), (set(ADJECTIVES), ADJECTIVES), (set(VIRTUES), VIRTUES)]


def varied(text: str, label: int, times: int, seed: int = 13) -> Iterator[tuple[str, int]]:
    """A reviewed sentence and variations of it: other words of the same kind, other spellings, other surroundings."""
    r = random.Random(f"{seed}{text}")
    yield text, label
    for _ in range(times - 1):
        words = []
        for w in text.split(" "):
            core = w.strip(".,!?;:\"'")
            for known, others in _KINDS:
                if core.lower() in known and r.random() < 0.7:
                    w = w.replace(core, r.choice(others))
                    break
            words.append(w)
        yield _disguised(" ".join(words), label, r), label
