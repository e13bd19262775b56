"""Default settings of the engine. They decide results."""

CHAR_SIZE = 32
APPLY_DENOISE = False
HORIZONTAL_VALLEY_THRESHOLD = 10
VERTICAL_VALLEY_THRESHOLD = 2
CHAR_MIN_HEIGHT = 10
CHAR_MAX_HEIGHT = 200
HOG_GRID_COLS = 4
HOG_GRID_ROWS = 3
HOG_BINS = 9
HOG_EPSILON = 0.001
KNN_K = 3
KNN_EPSILON = 0.001

SAMPLES_PER_CHARACTER = 160
FONTS = ("Arial", "Times New Roman", "Courier New", "Helvetica")
ROTATION_RANGE = 5.0
SCALE_RANGE = 0.1
NOISE_LEVEL = 0.05
SKEW_RANGE = 10.0
TRAIN_TEST_SPLIT = 0.8
MIN_ACCURACY_THRESHOLD = 0.8

OCR_ALPHABET = tuple("0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz")
LABELING_TARGET_PER_CLASS = 100
DATASET_PARTITIONS = ("train", "validation", "test")

ADJACENT_WINDOW = 15
NUMERIC_EPSILON = 0.005
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
ALLOWED_MIME_TYPES = ("image/jpeg", "image/png")
MIN_CAPTURE_AREA = 640 * 480

DOCUMENT_TYPES = ("invoice_es",)
DOCUMENT_STATUSES = ("uploaded", "processing", "processed", "validated", "failed", "rejected")
VALIDATION_FIELDS = ("proveedor", "nit", "fecha", "iva", "valor", "total")
NUMERIC_VALIDATION_FIELDS = ("iva", "valor", "total")
AUDIT_ACTIONS = (
    "LOGIN",
    "DOCUMENT_CREATED",
    "IMAGE_CAPTURED",
    "OCR_STARTED",
    "OCR_COMPLETED",
    "OCR_FAILED",
    "OCR_VALIDATED",
    "OCR_CORRECTED",
    "DOCUMENT_VIEWED",
    "DOCUMENT_DELETED",
    "MODEL_TRAINED",
    "MODEL_ACTIVATED",
    "DOCUMENT_REJECTED",
    "MODEL_DEACTIVATED",
)

DOCUMENT_TYPE_LABELS = {"invoice_es": "Factura"}
DOCUMENT_STATUS_LABELS = {
    "uploaded": "Cargado",
    "processing": "Procesando",
    "processed": "Procesado",
    "validated": "Validado",
    "failed": "Error",
    "rejected": "Rechazado",
}
VALIDATION_FIELD_LABELS = {"proveedor": "Proveedor", "nit": "NIT", "fecha": "Fecha", "iva": "IVA", "valor": "Valor", "total": "Total"}
DOCUMENTS_REPORT_HEADERS = ("ID", "Tipo", "Status", "Accuracy", "ValidadoEn", "UsuarioValidó", "FechaCreación")
DOCUMENTS_REPORT_NAME, VALIDATIONS_REPORT_NAME = "documentos", "validaciones"
VALIDATIONS_REPORT_HEADERS = ("DocumentoID", "Campo", "ValorOCR", "ValorValidado", "EditadoPor", "FechaValidación")

TARGET_CHARACTER_ACCURACY = 0.85
TARGET_FIELD_ACCURACY = 0.8
TARGET_MS = 5000
TARGET_REPRODUCIBILITY = 1

DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
TREND_DAYS = 7
DISPLAY_ZONE = "America/Bogota"
