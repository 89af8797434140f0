"""A small labelled table of manual lines: the training data of the line labeller.

Labelled by hand. ``H`` running header or footer, ``P`` page number, ``T`` section heading or
list item, ``B`` body text; an empty line is a break; ``====`` ends a document. ``^`` stands
for a form feed.
"""

LABELLED = """
H Orvane Bath Chair User Manual
B Remove all packaging and unfold the frame on a level floor. Wipe the
B seat with a damp cloth and let it dry before the first use of the day.

T WARNING
B Do not use the chair while the brakes are released. Check each screw once
B in four weeks and replace worn parts at once. If the frame shows cracks,
B stop using it.
T - padded armrest
T - foldable footplate
P 4
H ^Orvane Bath Chair User Manual
B The chair meets the drop limit of 20 cm. Store it below 40 °C and away
B from direct sunlight.

T Parts list
T - basket
T - hand grip
B Charge for 5 hours, then test the lever. The user must sit evenly on the
B seat and keep both feet on the footplate.
P 5
H ^Orvane Bath Chair User Manual
B The battery must not be opened. Press the button for 3 seconds to reset
B the control panel.
====
T CAUTION
B Only an authorized workshop may repair the lift. Replace the sling at
B least once in two years.

T Step 2
B Turn the knob until it clicks. The lift is rated for 200 openings before
B service is due.
H © Talmere – do not copy
P                               Page 11 of 40
H Owner’s Guide | Floor Lift
T Fig. 3
B Measure the distance between the bars; it should not exceed 12 mm. Before
B each use, check the sling.

T 2. Care
B Clean the cover with mild soap.
T Maintenance
B The cover can be washed. Let it dry for a day.
H © Talmere – do not copy
P                               Page 12 of 40
H Owner’s Guide | Floor Lift
B and tighten all screws. The lift comes with a charger.
====
H TALMERE  –  PULSE MONITOR
B The monitor should be inspected after six months of regular use. Noise
B stays under 20 dB.
T Specifications - frame
T - washable cover
B Order code Mavena-3 covers the sensor and four spare
H Rev. B 12/2019
P - 7 -
H TALMERE  –  PULSE MONITOR
B screws. Designed for home nursing, the monitor comes with a clip.

T CAUTION
B Do not bend the cable.
T Before first use
B Wipe the sensor.
H Rev. B 12/2019
P - 8 -
H TALMERE  –  PULSE MONITOR
T Adjusting the brakes
B Slide the clip into the holder, then tighten the knob.
====
B The rail supports daily transfers on uneven ground. Fits adults up to
B 300 lb even with one hand.

B Torque the bolts to 20 N·m. The rail replaces the older model and keeps
B its cover.
P     p. 19
H Section 4: Operation
T WARNING
B Do not lubricate the rail while the bed is moving. Noise stays under

B 30 dB on carpet.
P     xxi
H Section 4: Operation
T Step 3
B Many caregivers prefer a lightweight basket for storage. If the rail was
P [22]
H Section 4: Operation
B stored in a dry room, wait one hour.
====
H Bed Rail Instructions for Use
B Press the lever and pull the rail upward. Do not stand on the rail.
T Parts list
B Each rail leaves the workshop fully assembled.
H Bed Rail Instructions for Use
B The rail must be checked once a week. Keep this guide at hand for later
B use.
T NOTE
B Keep children away.
H Bed Rail Instructions for Use
B The rail is made of steel.
P 2-7
B The label shows the batch.
====
B Wipe the sling with a neutral detergent and let it dry for one hour. On
B the older model, the sling is rated for 30 cycles before service is due.

T CAUTION
B Replace the sling once in three years.

T CAUTION
B Do not cut the belt.
T Maintenance
B Check the belt for cracks.
T Maintenance
B Keep it dry.
P 12 | Orvane
B The belt locks securely.
P Orvane 13
B Store it away from heaters.
""".strip("\n")
