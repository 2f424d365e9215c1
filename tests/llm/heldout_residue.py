"""Wordings of residue and of ordinary sentences, written before the operator's forms were opened to new wordings and not used to choose them.

DEV was looked at while the forms were made, HELD_OUT only measured.
"""

DEV = [
    "Page not available, please check the address and try once more.", "Sorry, we can't find the page you were looking for.", "Internal error: the operation could not be completed.", "Connection to the server timed out.",
    "Access denied. You do not have permission to view this document.", "Your login has timed out, please sign in again.", "The file could not be opened because it is damaged.", "Segmentation fault (core dumped)",
    "java.lang.IllegalStateException: stream has already been closed", "ERROR: relation visits does not exist", "This site needs JavaScript to work.", "JavaScript is disabled in your browser.", "Please turn on scripting and reload the page.",
    "[Patient Name]", "<<DATE_OF_BIRTH>>", "{{#if diagnosis}}", "Dear [NAME],", "Diagnosis: <to be completed>", "Weight: N/A kg #DIV/0!", "INSERT TEXT HERE", "Type your text here", "This is a sample text, delete it before sending.",
    "Η σελίδα δεν βρέθηκε.", "Η σύνδεση με τον διακομιστή διακόπηκε.", "Δεν έχετε δικαίωμα πρόσβασης σε αυτό το έγγραφο.", "Παρουσιάστηκε εσωτερικό σφάλμα, προσπαθήστε αργότερα.", "Η υπηρεσία δεν είναι διαθέσιμη αυτή τη στιγμή.",
    "Για να δείτε τη σελίδα ενεργοποιήστε τη JavaScript.", "Ο περιηγητής σας δεν εκτελεί σενάρια.", "[ΟΝΟΜΑ ΑΣΘΕΝΟΥΣ]", "Εισάγετε κείμενο εδώ", "Κείμενο προς συμπλήρωση", "(συμπληρώστε διάγνωση)", "%%FIRST_NAME%%", "${patient.age}", "Συμπληρώνεται από τον ιατρό: ________",
]
HELD_OUT = [
    "The document you requested does not exist on this server.", "Sorry, this record is temporarily unavailable.", "404 Not Found", "502 Bad Gateway", "An unexpected error has occurred. Please contact the administrator.", "Request timed out while waiting for the database.",
    "You are not authorised to access this page.", "Session timeout. Please log in again.", "The report could not be generated.", "Failed to load resource: the server responded with an error", "Traceback (most recent call last): File main.py", "NullReferenceException: object reference not set",
    "This page requires JavaScript to be enabled.", "Enable scripts in your browser settings to continue.", "Scripts are blocked by your browser.", "You need to allow JavaScript to see this content.",
    "[Insert diagnosis]", "{{ patient.first_name }}", "<%= user.name %>", "Dear <<NAME>>,", "Age: ${AGE} years", "[DATE]", "#VALUE!", "Dosage: undefined mg", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Placeholder text for layout purposes", "Enter your comments here", "TODO: fill in later",
    "Η σελίδα που αναζητάτε δεν υπάρχει.", "Σφάλμα διακομιστή 500.", "Η υπηρεσία είναι προσωρινά μη διαθέσιμη.", "Η συνεδρία έληξε, συνδεθείτε ξανά.", "Δεν έχετε πρόσβαση σε αυτή τη σελίδα.", "Αδυναμία σύνδεσης με τη βάση δεδομένων.", "Παρουσιάστηκε απρόσμενο σφάλμα.", "Το αρχείο δεν μπόρεσε να ανοίξει.",
    "Ενεργοποιήστε τη JavaScript για να συνεχίσετε.", "Η εφαρμογή χρειάζεται JavaScript για να λειτουργήσει.", "[ΗΜΕΡΟΜΗΝΙΑ]", "[εισάγετε διάγνωση]", "<συμπληρώστε όνομα>", "Δείγμα κειμένου, να αντικατασταθεί.", "Πληκτρολογήστε εδώ το κείμενό σας.", "Εδώ γράψτε τα ευρήματα.",
]
#: Sentences that only speak of such things.
ORDINARY = [
    "Η συσκευή εμφάνισε ένδειξη Error 17 και αντικαταστάθηκε.", "The pump showed an error code and was replaced by the nurse.", "Ο ασθενής δεν βρέθηκε στον θάλαμο κατά την επίσκεψη.", "No access to the femoral vein was possible, so the radial artery was used.",
    "Η υπηρεσία κοινωνικής εργασίας ενημερώθηκε.", "The server room of the hospital was flooded in May.", "Η σελίδα του ιστορικού συμπληρώθηκε από τον ειδικευόμενο.", "The patient could not be reached by telephone.", "Η λήψη ιστορικού δεν ήταν δυνατή λόγω αφασίας.",
    "Null hypothesis of no difference was rejected.", "Η πρόσβαση στην αρτηρία απέτυχε δύο φορές.", "The laboratory service is available on weekdays.", "Η σύνδεση με τον αναπνευστήρα διακόπηκε για δέκα λεπτά.", "He reported that his internet connection had timed out during the visit.",
    "Σφάλμα στη δοσολογία διορθώθηκε από τον φαρμακοποιό.", "The department enabled JavaScript in the booking application last year.", "Το αίτημα του ασθενούς για μεταφορά εγκρίθηκε.", "The request for a second opinion was granted.", "Φορολογικό έντυπο: συμπληρώνεται από τον λογιστή του νοσοκομείου.",
    "Ο διακομιστής του ακτινολογικού αναβαθμίστηκε τον Μάρτιο.", "Results [see table 2] were normal.", "Dose was reduced (by half) on day 3.", "Sodium <135 mmol/L and potassium >5 mmol/L.", "Το δείγμα κειμένου γραφής του ασθενούς έδειξε μικρογραφία.",
]
