"""A small labelled table of text blocks: the training data of the boilerplate classifier.

Labelled by hand, page by page, as neighbours matter. ``-`` marks page furniture, ``+`` main
content; a blank line ends a page. ``= slug`` gives the page's own product, ``@`` the slugs of
its site's link targets. The first five pages are worded like the given tables, the others
are made up independently: shops of care, mobility and laboratory goods as they are usual on
the web, in English, French and German.
"""

#: The most blocks the classifier is fitted on; training refuses a longer table.
MOST_BLOCKS = 2_000

LABELLED = """
= orvane-padded-walking-aid
@ home shop mobility respiratory lab-supplies bath-safety beds-rails all-departments my-account wish-list contact
- We use cookies to remember your basket and measure traffic. Accept all | Settings
- Skip to main content
- Language: English | Currency: USD
- Home | Shop | Mobility | Respiratory | Lab Supplies | Bath Safety | Beds & Rails
- All Departments
- Search entire store here...
- My Account
- Log in / Register
- Wish List
- Your basket: 3 items
- Home > Mobility > Walking Aid
+ Orvane Padded Walking Aid
+ The padded hand grip supports outdoor walking and folds flat afterwards.
+ Do not immerse the battery pack while the cover is wet. Charge for 5 hours, then test the brake lever.
+ Specifications
+ Seat width: 20 in
+ Warranty: 2 years
+ Battery: 12 V
+ Menu button on the hand control.
+ Ventilated backrest
+ Latex free.
+ Contact a clinician before first use.
+ What’s included
+ 2 × carry strap
- Customers also viewed
- Talmere Swivelling Transfer Seat
- Ostrand Foldable Bath Chair $39.90
- Free delivery on orders over $50
- Share this page
- Back to top
- © 2023 Carevale. All rights reserved.
- Carevale, Unit 5, Northgate Trade Park
- Terms of Service

= talmere-textured-glove-exam
@ brands clearance rentals gift-cards track-order store-locator blog contact about-us
- This site stores small files on your device to improve your visit. Reject non-essential
- Your privacy choices matter as set out in our policy. Got it!
- We use cookies to remember your basket. Got it!
- Cookies help us run this store and show offers that interest you. Manage preferences
- Carevale and its partners use tracking technologies. By continuing you agree.
- Carevale and its partners use tracking technologies to remember your basket. Got it!
- Your privacy choices matter to improve your visit. By continuing you agree.
- Cookies help us run this store as set out in our policy. By continuing you agree.
- © 2024 Carevale. All rights reserved.
- Brands
- Clearance
- Rentals
- Gift Cards
- Track Order
- Store Locator
- Blog
- Contact
- About Us
- Brands » Blog » Glove, Exam
+ Talmere Textured Glove, Exam
+ Search light on the front mast.
+ Share the load with dual handles.
+ Made without natural rubber.
+ Details
+ Handle height: 90 mm
+ Product weight: 7 kg
+ Weight capacity: 300 lbs
+ Basket included.
+ Ships in two cartons.
+ Cookie-size puck magnet holds the tubing.
+ Package contents
+ 1 × lifting sling
- Related items
- Orvane Height-Adjustable Sample Box
- Ostrand Low-Profile 4-Wheel Walker
+ Home use and clinic use approved.
+ Limited lifetime warranty on the frame.
- Sign up for 10% off your first order
- Join our mailing list for deals
- Get offers by email – enter your address
- Be first to hear about new arrivals at Carevale
- Chat with an expert
- Call us Mon–Fri 8–5: 555-0100
- Follow us
- Shipping Information • Returns & Refunds • Privacy Notice • Site map • Accessibility • Careers • Do not sell my information • Secure checkout
- Prices exclude sales tax where due
- Advertisement
- Loading...

= ostrand-foldable-bath-chair
@ accueil boutique mon-compte panier nos-marques contactez-nous salle-de-bain respiratoire mobilite
- Ce site enregistre des traceurs afin de mesurer l’audience. Tout accepter
- Nous utilisons des cookies pour améliorer votre visite. Continuer sans accepter
- Carevale respecte votre vie privée et personnaliser les offres. Paramétrer
- Accueil
- Boutique
- Rechercher
- Mon compte
- Se connecter
- Panier
- Votre panier : 2 articles
- Nos marques
- Contactez-nous
- Salle de bain
- Accueil / Respiratoire / Bath Chair
+ Ostrand Foldable Bath Chair
+ Température conseillée : 22 °C, hygrométrie modérée.
+ N’essayez pas de démonter la housse imperméable lorsque l’usager est assis.
+ Grâce à sa légèreté, l’ensemble facilite la toilette et le séjour à l’hôpital.
+ Nettoyez le tuyau d’évacuation à l’eau tiède après chaque séance.
+ Vérifiez que le frein à main est bien fixé une fois par mois.
+ Si la poignée présente une fêlure, cessez l’usage où que vous soyez.
+ Pour les transferts quotidiens, réglez la sangle de levage avant l’utilisation.
+ Le modèle a été conçu pour la rééducation et résiste à 40 kg de charge répétée.
+ Technical data
+ Frame depth: 60 cm
+ Terms of warranty: 3 years frame, 6 months upholstery.
+ Follow the brake check in section 4.
- Vous aimerez aussi
- Produits similaires
- Talmere Washable Air Mattress
- Livraison offerte dès 49 €
- Recevez 10 % de remise par e-mail
- Inscrivez-vous à la lettre d’information
- Partager cette page
- Haut de page
- Mentions légales | Plan du site | Conditions de vente | Livraison et retours | © 2022 Carevale – Tous droits réservés
- Carevale, 12 zone d’activité, Miramont

= orvane-removable-suction-pump
@ startseite marken mobilitat angebote warenkorb mein-konto sortiment kontakt bad-dusche atemtherapie
- Diese Seite speichert Daten auf Ihrem Gerät, um Ihren Besuch zu verbessern. Alle akzeptieren
- Carevale achtet Ihre Privatsphäre und für passende Angebote. Einstellungen
- Startseite › Marken › Mobilität › Angebote › Warenkorb › Mein Konto
- Sortiment
- Suche
- Kontakt
- Bad & Dusche
- Atemtherapie
- Warenkorb: 1 Artikel
+ Orvane Removable Suction Pump
+ Die zulässige Belastung beträgt 90 kg; größere Lasten beschädigen den Rahmen.
+ Für den täglichen Gebrauch lässt sich die Rückenlehne stufenlos verstellen.
+ Reinigen Sie das Hebetuch nach der Wäsche mit milder Lösung. Prüfen Sie, ob der Griff fest sitzt.
+ Übermäßige Hitze über 30 °C kann das Gehäuse verfärben. Das Zubehör ist separat erhältlich.
+ Lösen Sie die Fußraste nicht, während der Benutzer sitzt.
+ Privacy curtain ships separately.
+ Some assembly required.
+ Details
+ In the box
+ 3 × drain valve
- Ähnliche Artikel
- Das könnte Ihnen gefallen
- Talmere Non-Slip Floor Lift $310.20
- Versandkostenfrei ab 30 €
- 10 % Rabatt per E-Mail sichern
- Jetzt Newsletter abonnieren
- Seite teilen
- Nach oben
- Impressum - AGB - Datenschutz - Versand & Rückgabe - Carevale, Halle 7, Miramont
- © 2021 Carevale – Alle Rechte vorbehalten

= talmere-quick-release-lab-cooler
@ help-center mobility respiratory
+ Collapses to fit a car boot
+ Tool-free seat cushion
+ Reinforced filter housing
+ Adjustable charging port
+ Washable splash guard
+ Removable push handle
+ Impact-resistant anti-tip bar even with one hand
+ Padded armrest
+ Padded backrest
+ Swivelling basket when the brakes are engaged
+ Non-slip hand grip on uneven ground
+ Caregivers report that the padded hand grip saves about 5 minutes per shift.
+ Foldable footplate
+ Low-profile basket
+ Washable armrest
+ Swivelling crossbar
+ Self-locking hand grip
+ Contoured transfer board in tight spaces
+ Height-adjustable commode bucket for most users
+ The seat measures 18 × 20 in and the rear wheel adjusts in ½ in steps.
+ Torque the bolts of the front caster to 20 N·m in a dry room.
+ Noise stays under 30 dB in a parked vehicle.
+ Many caregivers prefer a lightweight control panel for storage and transport.
+ Wipe the tubing connector with a damp cloth and let it dry for two weeks.
+ Our adults team compared the Malvenna with the Torvido during daily transfers.
+ Each rollator leaves the workshop with its footplate fully assembled.
+ Fits adults up to 250 lb.
+ Fits caregivers up to 300 lb.
+ The patient lift should be inspected after two weeks of regular use.
+ If the armrest shows leaks, stop using the suction pump.
+ Non-slip basket
+ Removable basket
+ Basket on wheels
+ The user’s weight must rest evenly on the mattress cover.
+ The Torvido replaces the older Malvenna and keeps its crossbar.
+ A label under the basket shows the batch, for example Torvido7.
+ If the bed rail was stored on carpet, wait one hour before use.
+ Non-slip basket – indoors or outdoors
+ Quick-release hand grip without extra tools
- Add to Cart
- Add to wish list
- Qty: 1
- (12 reviews)
- Write a review and win
- Be the first to review this product
- Compare (2)
- Filter by price
- Sign in for pricing
- Financing from $19/month
- Notify me when back in stock
+ Only an authorized workshop may repair the side rail of the Marvenna.
- Share on social media
- Email a friend
- Print | Email a friend
- Need help? Call 555-0100
- Visit the Carevale store
- Read more
- View all specifications
- Ask a question about this page
- Back to Orvane Bath Chair
- Customers also bought: Ostrand Knee Walker
- Frequently bought together
- More from this brand
- You may also like
- Recently viewed
- Help Center
- Subscribe
- Mobility
- Respiratory
- Mobilité
- Respiratoire
- Mobilität
- Angebote
- Warenkorb
- Marken
+ Details
- Join our newsletter
- We use cookies and show offers that interest you. By continuing you agree.
- Do not sell my information | Site map | Prices exclude sales tax where due | Accessibility | © 2020 Carevale. All rights reserved.
- Free shipping over $40
+ Press “SET” for 3 seconds to reset the backrest.
+ Casters: 5 in
+ Store below 30 °C and away from direct sunlight.

= harlow-steel-rollator
@ home products walking-aids wheelchairs delivery stores account cart search
- We and our partners store cookies on your device to measure visits and show you offers. Accept | Decline | More options
- Skip to navigation
- Home | Products | Walking Aids | Wheelchairs | Delivery | Stores
- Account
- Cart
- Search
- Language: EN | Currency: EUR
- Home > Walking Aids > Rollators
+ Harlow Steel Rollator
+ A steel rollator with two brakes, made for daily walks on pavements and indoor floors. The frame folds with one hand and stands on its own.
+ Never lift the walker by its cables. Check both brakes before each walk, and have worn pads replaced by a workshop.
+ Specifications
+ Seat height: 54 cm
+ Maximum load: 130 kg
+ Features
+ Lightweight aluminium fork
+ Padded back strap
+ Lockable front wheels
+ Bell and reflectors.
+ What is in the package
+ 1 × walker
+ 2 × brake cable
- You might also like
- Marlow Folding Rollator $129.00
- Benton Carbon Walker
- Benton Compact Shower Stool $45.50
- Free shipping on orders above $75
- Sign up to our newsletter and save 5%
- Share
- Back to start
- Delivery and returns | Privacy policy | Terms and conditions | Sitemap
- © 2021 Harbourcare Ltd. All rights reserved.
- Harbourcare Ltd, Unit 2, Eastfield Business Park

= quillon-bed-table
@ beds bathroom kitchen-aids offers new-arrivals contact help
- COOKIES HELP US DELIVER OUR SERVICES. BY USING THIS SITE YOU AGREE TO THEIR USE. GOT IT | SETTINGS
- BEDS · BATHROOM · KITCHEN AIDS · OFFERS · NEW ARRIVALS
- CONTACT
- HELP
- SEARCH OUR SHOP
- BASKET: 2 ITEMS
- BEDS > TABLES > BED TABLE
+ Quillon Bed Table
+ The table top tilts in five steps and holds a tray, a laptop or a book. Its base slides below most care beds.
+ Wipe the top with mild soap and dry it at once; do not use bleach.
+ Details
+ Table top: 60 x 40 cm
+ Weight: 8 kg
+ Warranty: 5 years
+ Tilting table top
+ Swivel casters with brakes
+ Raised edge keeps cups in place
+ Suitable for left and right handed users.
+ Some tools required for assembly.
- CUSTOMERS WHO VIEWED THIS ALSO VIEWED
- ALDER BEDSIDE CABINET $210.00
- QUILLON OVERBED LIGHT
- ALDER FALL MAT
- CALL OUR TEAM MON–SAT 8–6: 555-0111
- CHAT WITH US NOW
- GET 10% OFF YOUR FIRST ORDER
- PRINT THIS PAGE | EMAIL TO A FRIEND
- SHIPPING • RETURNS • WARRANTY CLAIMS • CAREERS • PRESS
- © 2019 QUILLSHOP – ALL RIGHTS RESERVED

= pavo-lab-shaker
@ shop centrifuges pipettes glassware brands support blog
- This website uses cookies. Essential only | Allow all
- Shop » Brands » Blog » Support
- Log in / Sign up
- My orders
- Wish list
- Compare products (3)
- Shop » Shakers » Lab Shaker
+ Pavo Lab Shaker
+ For bottles, flasks and plates up to 4 litres. The speed holds within two percent over a full shift, and the drive needs no oil.
+ Press the green key for 2 seconds to start the timer. Hold “STOP” for 5 seconds to reset it.
+ The clamps are rated for 500 operating hours; after that the springs lose force.
+ If the platform rattles, tighten its four screws to 3 N·m and check the mat for wear.
+ Technical data
+ Orbit: 10 mm
+ Speed: 20–300 rpm
+ Fuse: 2 A
+ Quiet brushless motor
+ Non-slip rubber mat
+ Removable drip tray
+ Stackable up to three units
+ Keeps samples cool in a heated room
+ Order code PV-200 covers the clamp set and the platform.
- Related products
- Orrin Vortex Mixer $310.00
- Orrin Magnetic Stirrer $189.00
- Pavo Incubator
- Recently viewed products
- Ask our experts
- Request a quote
- Follow us on social media
- Terms of use - Privacy notice - Imprint - Accessibility statement
- © 2020 Labhaven GmbH. All rights reserved.

= tarn-shower-chair
@ bathing toilets grab-bars rentals gift-cards faq
- Your privacy matters to us. Manage cookie preferences
- Bathing
- Toilets
- Grab Bars
- Rentals
- Gift Cards
- FAQ
- Store finder
- Track your order
- Sign in
+ Tarn Shower Chair
+ Stainless screws and a one-piece seat keep water from collecting, so the chair is clean after a quick rinse.
+ The feet adjust without tools; each click changes the height by one inch.
+ Store the chair dry and below 45 °C when it is not in use.
+ Not for users who cannot sit upright by themselves. Ask a therapist if in doubt.
+ Features
+ Rustproof frame
+ Contoured plastic seat
+ Hygiene cut-out at the front
+ Rubber feet grip wet tiles
+ Free of latex and phthalates.
+ Fits users up to 150 kg.
+ Also sold as a set with a back rest.
+ Contact points are rounded for safe transfers
+ Search for cracks in the seat once a month.
+ Follow the torque table in chapter 2.
- Advertisement
- Loading more
- Write a review
- Be the first to write a review
- (7 reviews)
- Add to basket
- Quantity: 1
- Save for later
- Notify me when available
- Sign in to see your price
- Pay in 12 months from $9
- Filter by brand
- Sort by price
- Show all specifications
- See more
- Return to Shower Chairs
- Often bought together
- Others also bought: Tarn Bath Board
- More of this brand
- View recently seen items
- Site map
- Careers
- Secure payment
- All prices include VAT and exclude delivery
- Join our mailing list and be first to hear about deals
- Enter your e-mail address
- Subscribe
- Top of page

= ember-heated-blanket
@ comfort therapy sleep sale my-account about-us contact-us
- We use cookies to keep you signed in, remember what is in your bag and improve the shop. OK
- Comfort / Therapy / Sleep / Sale
- My Account
- About Us
- Contact Us
- Menu
- All categories
- Search entire catalogue
- Your bag: 0 items
- Comfort / Blankets / Heated Blanket
+ Ember Heated Blanket
+ Three heat levels, and a timer that turns the blanket off after ninety minutes. The cable detaches so the blanket can be washed at 30 °C.
+ Do not fold the blanket while it is warm. Keep pins and pets away from it.
+ Specifications
+ Power: 110 W
+ Size: 180 x 130 cm
+ Machine washable fleece
+ Switch with light for use in the dark
+ Menu key on the handset
+ Privacy label inside the hem
+ Account for shrinkage of 2 percent after the first wash.
+ Home and ward use.
+ Basket weave cover
+ Share it: both sides heat separately
+ Lifetime guarantee on the heating wire.
+ Terms: 2 years on parts, 1 year on the cover.
+ Ships with a storage bag.
+ In the box
+ 1 × blanket
+ 1 × handset
- Similar items
- Ember Foot Warmer $39.90
- Calder Wool Throw
- Calder Knee Rug $25.00
- Free delivery from $60
- Need advice? Call 555-0144
- Live chat
- Share on social media
- Do not sell or share my personal data
- Ember Home, Unit 14, Millbrook Trade Park
- Returns and refunds
- Shipping info
- Privacy notice
- Terms of sale
- Accessibility
- Follow us
- © 2018 Ember Home

= lumen-siege-de-bain
@ accueil boutique salle-de-bains mobilite promotions compte panier
- Ce site utilise des cookies pour mesurer son audience et vous proposer des offres adaptées. Accepter | Refuser | Préférences
- Nous respectons votre vie privée. Gérer les traceurs
- Accueil | Boutique | Salle de bains | Mobilité | Promotions
- Mon compte
- Mon panier : 1 article
- Connexion
- Rechercher un produit
- Nous contacter
- Nos magasins
- Nos marques
- Respiration
- Accueil > Salle de bains > Sièges
+ Lumen Siège de bain
+ Le siège s’installe sur la baignoire sans outil et supporte un usage quotidien. Son assise tourne et se bloque dans quatre positions.
+ Ne montez jamais debout sur l’assise. Vérifiez les ventouses avant chaque bain et remplacez-les si elles sont usées.
+ Nettoyez la housse à l’eau savonneuse et laissez-la sécher à l’air libre.
+ Pour les transferts, bloquez les roues et abaissez l’accoudoir du côté de l’usager.
+ La charge maximale est de 120 kg ; au-delà, le cadre peut se déformer.
+ Température de stockage : 5 à 40 °C, à l’abri du soleil.
+ Grâce à ses poignées larges, l’appareil se déplace facilement dans un couloir étroit.
+ Si un bruit apparaît, cessez l’usage et contactez un atelier agréé.
+ Le modèle est livré avec sa sangle, son coussin et une notice.
+ Specifications
+ Seat width: 40 cm
+ Weight capacity: 120 kg
+ Washable seat cover
+ 2 × suction foot
- Vous aimerez aussi
- Articles similaires
- Vus récemment
- Solen Tapis de bain 19,90 €
- Solen Barre d’appui
- Livraison gratuite dès 60 €
- Abonnez-vous à notre lettre d’information et recevez 5 % de remise
- Votre e-mail
- Partager
- Retour en haut
- Mentions légales | Plan du site | Conditions générales de vente | Livraison et retours | Données personnelles
- © 2021 Lumen Santé – Tous droits réservés
- Lumen Santé, 4 zone artisanale, Clairval

= orso-fauteuil-releveur
@ accueil fauteuils lits aides-a-la-marche conseils contact
- Les cookies assurent le bon fonctionnement de nos services. Tout accepter | Continuer sans accepter
- Votre confidentialité compte pour améliorer votre visite. Paramétrer
- Fauteuils › Lits › Aides à la marche › Conseils
- Contact
- Se connecter
- Panier
- Recherche
+ Orso Fauteuil releveur
+ Le moteur électrique relève le dossier et le repose-jambes, et aide l’usager à se lever sans effort.
+ Débranchez l’appareil avant de le nettoyer. N’utilisez pas de produit abrasif sur le cuir.
+ La télécommande reste à portée de main dans sa poche, et se verrouille par une clé.
+ Prévoyez un espace de 30 cm derrière le dossier pour l’incliner.
+ Details
+ Motor: 24 V
+ Upholstered armrest
- Produits associés
- Les clients ont aussi acheté
- Orso Repose-pieds 79,00 €
- Paiement sécurisé
- Service client du lundi au vendredi 9–18 h
- Imprimer la page
- Conditions d’utilisation
- Plan du site
- Suivez-nous
- © 2020 Orso Confort – Tous droits réservés

= falk-pflegebett
@ startseite produkte betten bad mobilitaet angebote konto warenkorb kontakt
- Wir verwenden Cookies, um den Besuch zu verbessern und passende Angebote zu zeigen. Zustimmen | Ablehnen | Einstellungen
- Startseite | Produkte | Betten | Bad | Mobilität | Angebote
- Konto
- Warenkorb: 0 Artikel
- Kontakt
- Anmelden
- Suche im Shop
- Marken
- Dusche & WC
- Atmung
- Startseite › Betten › Pflegebetten
+ Falk Pflegebett
+ Das Bett lässt sich elektrisch in der Höhe verstellen, und das Kopfteil neigt sich stufenlos bis 70 Grad.
+ Prüfen Sie vor jeder Benutzung, ob die Seitengitter fest eingerastet sind.
+ Reinigen Sie den Rahmen mit einem feuchten Tuch. Die Matratze darf nicht im Freien gelagert werden.
+ Die zulässige Last beträgt 185 kg; schwere Stöße beschädigen die Rollen.
+ Lösen Sie die Bremse erst, wenn der Benutzer sicher sitzt oder liegt.
+ Für den Transport wird das Gestell in zwei Teile zerlegt, das Zubehör ist getrennt verpackt.
+ Bei Temperaturen über 35 °C schaltet der Motor zum Schutz ab.
+ Specifications
+ Mattress size: 90 x 200 cm
+ Product weight: 96 kg
+ Folding side rail
+ In the box
+ 4 × caster
- Ähnliche Produkte
- Das könnte Sie auch interessieren
- Zuletzt angesehen
- Falk Nachttisch 149,00 €
- Rieger Aufrichter
- Gratis Versand ab 50 €
- Newsletter bestellen und 5 % Rabatt sichern
- Seite weiterempfehlen
- Zum Seitenanfang
- Impressum | AGB | Datenschutzerklärung | Versandkosten | Rückgabe
- © 2022 Falk Reha – Alle Rechte vorbehalten
- Falk Reha, Halle 3, Lindau

= rieger-toilettenstuhl
@ sortiment bad-und-wc gehhilfen service
- Diese Webseite speichert Cookies auf Ihrem Gerät. Alle akzeptieren
- Wir achten Ihre Privatsphäre. Auswahl speichern
- Sortiment › Bad und WC › Gehhilfen › Service
- Mein Konto
- Warenkorb
- Suche
- Einloggen
+ Rieger Toilettenstuhl
+ Der Stuhl steht auf vier Gummifüßen und passt über die meisten Toiletten.
+ Entnehmen Sie den Eimer nach oben und spülen Sie ihn mit klarem Wasser.
+ Die Armlehnen tragen das Gewicht beim Aufstehen und lassen sich abnehmen.
+ Wird der Sitz rissig, verwenden Sie den Stuhl nicht weiter.
+ Details
+ Seat height: 45 cm
+ Removable bucket
- Kunden kauften auch
- Weitere Artikel dieser Marke
- Rieger Duschhocker 59,90 €
- Kostenloser Rückversand
- E-Mail-Adresse eingeben
- Seite drucken
- Folgen Sie uns
- Jobs
- Versand & Zahlung
- Datenschutz
- © 2019 Rieger

= corvin-oxygen-trolley
@ oxygen masks tubing care-kits store-locator track-order clearance
- Cookies remember your settings and tell us which pages are read. I agree | Choose
- Corvinshop and its partners use similar technologies to show offers. Continue
- Oxygen | Masks | Tubing | Care Kits | Clearance
- Store Locator
- Track Order
- Help Center
- My Wish List
- Search
+ Corvin Oxygen Trolley
+ The trolley carries one cylinder and turns on the spot. Its handle locks at two heights, and the tyres stay quiet on tiles.
+ Secure the cylinder with both straps before you move it, and never leave it near a heater.
+ Nurses say the wide tyres save effort on ramps.
+ A plate on the axle shows the serial number, for example CT-4471.
+ The older model had no brake; this one stops with a foot lever.
+ Replace the strap if its edge frays.
+ Our team tried it with a full cylinder on wet ramps.
+ Clinics, care homes and drivers like the small footprint.
+ Most visitors are surprised how light it is.
+ Features
+ Puncture-proof tyres
+ Foot-operated brake
+ Powder-coated tube frame
+ Reinforced cylinder cup
+ Adjustable strap
+ Padded handle
+ Washable strap
+ Detachable hose hook
+ Anti-tip rear bar
+ Splash-proof control box
+ Quick-release axle without tools
+ Low entry for heavy cylinders
+ Foldable stand – for car boots and lockers
+ Works with most cylinder sizes
+ Locks itself on slopes
+ Battery: 12 V
+ Cable length: 2 m
+ Frame depth: 45 cm
+ Made in a smoke-free plant.
+ Cylinder not included.
+ Cookie-cutter clamp shape fits round tubes.
+ Read the safety sheet before use.
+ Call bell bracket on the right side
+ Help handle at the rear
+ Shop floor tested
+ Subscribe to no service plan: the trolley needs no upkeep.
+ Delivery hook for bags
+ Contents
+ 1 × trolley
+ 3 × strap buckle
- Related items
- Corvin Cylinder Cart $99.00
- Anders Oxygen Mask
- Anders Nasal Tube $4.90
- Corvin Height-Adjustable Stand
- Deals of the week
- Questions? Chat with our team
- Email this page to a friend
- Shipping rates - Return policy - Privacy - Legal - Jobs
- © 2023 Corvin Medical. All rights reserved.
""".strip("\n")


# Further pages are made by a rule, as names of products, features and other products differ by a few words only.
QUALITIES = "padded adjustable washable foldable removable reinforced textured ventilated contoured swivelling lightweight quick-release height-adjustable self-locking tool-free non-slip low-profile impact-resistant lockable self-closing".split()
PARTS = ["armrest", "backrest", "basket", "footplate", "crossbar", "side rail", "seat cushion", "brake lever", "hand grip", "front caster", "rear wheel", "battery pack", "charging port", "control panel", "drain valve", "filter housing", "mattress cover", "push handle", "splash guard", "lifting sling", "carry strap", "commode bucket", "transfer board", "tubing connector", "anti-tip bar", "carry bag", "footrest", "cross brace", "brake handle", "front wheel", "charging socket", "drain plug", "filter cover", "push bar", "shoulder strap", "toilet bucket", "hose connector"]
ENDS = ["", "", "", " for most users", " in narrow halls", " with one hand", " without tools", " on gravel", " while the brakes are set", " – at home or on the road", " and folds away"]
KINDS = ["Bath Bench", "Rollator", "Knee Walker", "Commode Chair", "Patient Lift", "Air Mattress", "Exam Gloves", "Lab Cooler", "Suction Pump", "Nebulizer", "Safety Rail for Bed", "4-Wheel Walker", "Bath Seat", "Knee Scooter", "Toilet Chair", "Patient Hoist", "Air Cushion", "Nitrile Gloves", "Lab Fridge", "Suction Unit", "Inhaler", "Rail for Bed", "3-Wheel Walker"]
MAKERS = ["Orvane", "Talmere", "Ostrand", "Calloway", "Brightmoor", "Hespera", "Harlow", "Quillon", "Tarn", "Ember", "Corvin", "Anders"]


def ruled_pages(n: int = 24) -> list[tuple[str, frozenset[str], list[tuple[bool, str]]]]:
    """(own product, link targets, (is furniture, line) rows) of n pages put together by the rule."""
    pages = []
    for i in range(n):
        pick = lambda xs, k: xs[(i * 7 + k * 5 + k * k) % len(xs)]  # noqa: B023, E731
        name = f"{pick(MAKERS, 0)} {pick(QUALITIES, 1).title()} {pick(KINDS, 2)}"
        places = [pick(["Shop", "Home", "Mobility"], i), pick(["Brands", "Rentals", "Blog"], i), pick(["Contact", "Offers", "Help"], i)]
        rows = [(True, p) for p in places] + [(True, " > ".join([*places[:2], pick(KINDS, 2)])), (False, name)]
        rows += [(False, f"{pick(QUALITIES, k).capitalize()} {pick(PARTS, k + i)}{pick(ENDS, k)}") for k in range(9)]
        rows += [(False, f"A {pick(QUALITIES, k)} {pick(PARTS, k)} and a {pick(PARTS, k + 3)} support daily use{pick(ENDS, k)}.") for k in range(3)]
        rows += [(False, pick(["Specifications", "Details", "In the box", "Features"], i))]
        rows += [(False, f"{k + 1} × {pick(PARTS, k)}") for k in range(2)]
        rows += [(True, pick(["Related items", "Customers also viewed", "More of this brand", "Articles similaires", "Recently viewed"], i))]
        rows += [(True, f"{pick(MAKERS, k + 1)} {pick(QUALITIES, k + 2).title()} {pick(KINDS, k + 3)}{f' ${20 + 13 * k}.90' if k % 2 else ''}") for k in range(4)]
        rows += [(True, f"Return to {pick(MAKERS, 2)} {pick(KINDS, 4)}"), (True, f"© {2010 + i % 14} {pick(MAKERS, 3)}shop"), (True, f"{pick(MAKERS, 3)}shop, Unit {i + 2}, {pick(MAKERS, 5)} Trade Park")]
        pages.append((name.lower().replace(" ", "-"), frozenset(p.lower() for p in places) if i % 3 else frozenset(), rows))
    return pages
