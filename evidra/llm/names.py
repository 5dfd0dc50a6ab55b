"""Given names with the gender their surrogates keep, and words that are no surnames. An own list of common public names."""

FEMALE = frozenset("""
laura sofia sophia emily ingrid katarzyna marta clara zoë zoe fatima priya irene greta chloé chloe olga amara leila yuki maria anna amélie amelie elena
nina lucía lucia julia rachel beatriz mei anne marie sarah sara hannah lena lea mia emma olivia ava isabella charlotte amelia harper evelyn abigail
elizabeth eleanor margaret catherine katherine kathryn jennifer jessica ashley amanda stephanie nicole melissa rebecca michelle kimberly lisa angela
heather amy deborah debra donna carol sandra sharon cynthia kathleen susan nancy karen betty helen samantha christine christina janet diane alice julie
joyce victoria kelly lauren joan judith martha cheryl megan andrea jacqueline gloria teresa theresa doris kathy evelyne françoise francoise hélène helene
isabelle nathalie sylvie céline celine aurélie aurelie camille élodie elodie manon inès ines pauline mathilde juliette claire monique brigitte ursula
renate sabine petra monika birgit heike anja katja silke anke svenja johanna frieda ilse carmen pilar dolores rosa ana lola alba paula inés rocío rocio
ángela angela mercedes cristina joana mariana beatrice giulia chiara francesca alessandra valentina martina federica paola elisa giovanna agnieszka
małgorzata malgorzata joanna ewa barbara zofia hanna alicja magdalena natalia aleksandra karolina ayşe ayse fatma emine hatice zeynep elif meryem
özlem ozlem sevgi derya anastasia ekaterina tatiana natalya svetlana irina ludmila galina daria ksenia yulia aisha khadija zainab mariam noor layla
yasmin nadia samira ananya divya kavya lakshmi sunita anjali pooja neha sakura yoko keiko haruka naoko akiko hiroko xiu ying fang min-ji soo-jin
siobhan niamh aoife astrid sigrid freja linnea karin birgitta elin maja kirsten mette ngozi adaeze chiamaka wanjiru akua abena thandiwe
анна мария елена ольга наталья ирина светлана екатерина татьяна юлия дарья
""".split())
MALE = frozenset("""
david karl henrik ivan ravi jonas björn bjorn kwame kenji thomas hugo carlos peter paul tomás tomas ahmed lukas daniel andre andré mateo piotr samuel omar
james john robert michael william richard joseph charles christopher matthew anthony donald steven stephen andrew kenneth george joshua kevin brian
edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan larry justin scott brandon benjamin gregory alexander patrick jack dennis
jerry tyler aaron jose henry adam nathan douglas zachary kyle walter ethan jeremy harold keith christian roger noah gerald terry sean austin arthur
lawrence jesse dylan bryan joe jordan billy bruce albert willie gabriel logan alan juan wayne roy ralph randy eugene vincent russell louis philip bobby
johnny bradley oliver liam lucas mason elijah pierre jean françois francois jacques michel philippe nicolas julien antoine olivier laurent stéphane
stephane sébastien sebastien guillaume maxime théo theo mathieu luc yves hans jürgen jurgen klaus wolfgang dieter günter gunter uwe stefan andreas
markus matthias florian sebastian tobias felix moritz maximilian friedrich heinrich ludwig otto javier miguel antonio francisco manuel pedro alejandro
diego sergio fernando pablo jorge alberto luis rafael raúl raul álvaro alvaro adrián adrian enrique joão joao tiago rui nuno gonçalo goncalo duarte
vasco giuseppe giovanni marco luca matteo alessandro andrea lorenzo francesco roberto paolo stefano riccardo jan krzysztof andrzej tomasz paweł pawel
michał michal marcin jakub wojciech łukasz lukasz grzegorz mateusz stanisław stanislaw mehmet mustafa ali hüseyin huseyin hasan ibrahim emre murat burak
cem kemal serkan dmitri dmitry sergei sergey alexei alexey nikolai vladimir igor oleg mikhail boris pavel yuri anton maxim mohamed mohammed muhammad
hassan khalid tariq youssef karim bilal arjun rahul amit rohan vikram sanjay rajesh suresh vijay anil hiroshi takashi haruto yuto kazuki daisuke
satoshi akira wei jun lei hao min-ho sung-min seung lars nils anders erik magnus olof sven gustav axel rasmus søren soren mikkel chidi emeka kofi
kwabena kwasi juma thabo sipho eoin declan cormac ciaran padraig иван сергей дмитрий алексей андрей владимир михаил николай павел игорь
""".split())
GIVEN = FEMALE | MALE

#: Given names that are also ordinary words or handle parts: in lower case or in handles they prove nothing.
AMBIGUOUS = frozenset("amber ali jack joe roger terry ray scott harper jordan logan mason austin dolores mercedes lola alba rosa pilar carol joy jan min jun lei hao wei noor maja wayne bruce jesse kelly billy bobby randy marco luca paola seung felix otto max".split())

#: Words that begin sentences or stand capitalised beside a name without being a surname.
NO_SURNAME = frozenset("""
the a an and or but if so as at by for from in into of on to with without is are was were be been being am do does did has have had will would can could
should may might must shall not no yes he she it we they you i me him her us them my your his its our their this that these those who what when where why
how which there here then than too also just only even still very more most some any all both each every other another such same new old good great thanks
thank dear hi hello hey sorry please regards best cheers ping contact ask call text write talk signed mail tel whatsapp monday tuesday wednesday thursday
friday saturday sunday january february march april june july august september october november december street road avenue lane inc ltd gmbh corp llc
said says told asked wrote went came left moved runs ran works worked knows knew uses used thinks thought likes wants needs got gave made let gets makes
edit update note look try happy budget pricing version support route serial order invoice ticket commit latency coordinates self hosting somebody anyone
someone nobody everybody everyone nothing something before after since until while because although though however maybe perhaps honestly seriously again
now today tomorrow yesterday soon later first second third last next der die das und oder aber ist sind war ein eine wir ihr sie er es ich du nicht mit
für von zu im am bei nach le la les un une des et ou mais est sont nous vous ils elle il je tu ne pas avec pour de du au el los las uno una y o pero es son
nosotros no con para del al que w z na do i jest są nie się dla od po ve bir bu şu ile için из на в и не что для merci gracias danke dzięki obrigado cc re fwd via app pro plus one two api crm
zur zum vom beim ohne wenn dass ob wie wer wo
""".split())

#: Endings that surnames of many languages have; a lower-case word needs one to pass for a surname.
SURNAME_ENDING = r"(?:ova|eva|ski|ska|sky|owicz|ewicz|wicz|sson|sen|etti|elli|ini|ino|ides|idis|poulos|kamp|mann|berg|stein|bach|dale|ford|wood|field|mont|mura|moto|yama|brandt|voss|øy|oy|enko|czyk|escu|oglu|oğlu|ián|yan|sch|ham|well|gård|gaard|quist|ström|strom|lund|dóttir|dottir|ović|ovic|ić|ez|eira|eiro|ovich|evich|smith|jones|nguyen|patel|singh|khan|kim|ова|ева|ов|ев|ин|ина|ский|ская)"

#: Words after which, and words before which, a name is a person's.
PERSON_BEFORE = frozenset("""
mr mrs ms miss dr prof sir madam herr frau fräulein mme mlle monsieur madame señor señora señorita sr sra don doña pan pani signor signora bay bayan senhor senhora dear ask asked asking tell told met meet meeting
call called calling contact contacted email emailed mail mailed ping pinged thank thanks credit by from with to named name names is was am and signed sincerely regards yours hire hired colleague boss manager
friend neighbour neighbor sister brother cousin uncle aunt mother father wife husband son daughter teacher doctor nurse lawyer agent engineer author editor professor captain coach landlord tenant patient client
customer invited invite visit visited know knew married saw see heard reach for heißt namens von bei mit an merci à avec nommé appelle con de por llama gracias pana pan od z do
""".split())
PERSON_AFTER = frozenset("""
said says say told tells asked asks wrote writes called calls emailed mailed replied replies answered answers thinks thought knows knew wants wanted works worked runs ran approved approves left joined joins lives lived
died met meets agreed agrees signed signs sent sends promised has had is was who whose will would can could and here sagt sagte schreibt schrieb meint hat ist dit a est dijo dice es tem disse powiedział powiedziała dedi сказал сказала
""".split())
#: Words that make what stands before them, or of them a name, a place, a firm, a work or a product.
THING_WORDS = frozenset("""
river lake mountain mountains valley island islands bay beach creek falls park forest desert sea ocean bridge street road avenue square station airport harbor harbour port tower castle palace college university school institute academy hospital clinic
museum library theatre theater church cathedral hotel restaurant bar cafe stadium arena prize award foundation trust society club league cup trophy inc ltd llc gmbh corp company group bank airlines motors records press times post news magazine
metrics db database cloud sheets forms docs mail crm erp api app sdk cli os pro plus enterprise edition suite studio labs lab systems software solutions technologies analytics platform server desktop mobile editor engine framework library plugin
effect theorem law equation syndrome disease test scale index model method algorithm principle paradox award act day week month syndrome county city town village state province republic kingdom
""".split())
