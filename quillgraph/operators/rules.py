"""Catalogs of the layer classification: fixed values, in their natural order."""

from __future__ import annotations

# Endings of class names, the layer they speak for, and the weight.
CLASS_RULES = (
    ("controller", "controller", 1.0),
    ("restcontroller", "controller", 1.0),
    ("resource", "controller", 0.9),
    ("service", "business", 1.0),
    ("manager", "business", 0.8),
    ("orchestrator", "business", 0.9),
    ("usecase", "business", 1.0),
    ("use_case", "business", 1.0),
    ("repository", "data", 1.0),
    ("repo_impl", "data", 0.9),
    ("dao", "data", 1.0),
    ("entity", "data", 1.0),
    ("model", "data", 0.8),
    ("dto", "data", 0.9),
    ("mapper", "data", 0.8),
    ("transformer", "data", 0.8),
    ("converter", "data", 0.8),
    ("middleware", "middleware", 1.0),
    ("filter", "middleware", 0.8),
    ("interceptor", "middleware", 0.9),
    ("aspect", "middleware", 0.8),
    ("config", "config", 1.0),
    ("configuration", "config", 1.0),
    ("settings", "config", 0.9),
    ("helper", "utility", 1.0),
    ("util", "utility", 1.0),
    ("support", "utility", 0.8),
    ("handler", "controller", 0.8),
    ("adapter", "infrastructure", 1.0),
    ("client", "infrastructure", 0.9),
    ("connector", "infrastructure", 0.9),
    ("provider", "infrastructure", 0.8),
    ("factory", "infrastructure", 0.7),
    ("builder", "infrastructure", 0.6),
    ("validator", "utility", 0.8),
    ("exception", "utility", 0.6),
    ("error", "utility", 0.5),
)

# Words in file names.
FILE_RULES = (
    ("controller", "controller", 1.0),
    ("route", "controller", 0.9),
    ("handler", "controller", 0.8),
    ("service", "business", 1.0),
    ("manager", "business", 0.7),
    ("repository", "data", 1.0),
    ("dao", "data", 1.0),
    ("model", "data", 0.8),
    ("entity", "data", 0.9),
    ("middleware", "middleware", 1.0),
    ("filter", "middleware", 0.7),
    ("config", "config", 1.0),
    ("setting", "config", 0.8),
    ("util", "utility", 1.0),
    ("helper", "utility", 1.0),
    ("common", "utility", 0.7),
    ("shared", "utility", 0.7),
    ("migration", "migration", 1.0),
    ("migrate", "migration", 1.0),
    ("test", "testing", 1.0),
    ("spec", "testing", 1.0),
    ("benchmark", "testing", 0.8),
    ("view", "presentation", 0.8),
    ("component", "presentation", 0.8),
    ("page", "presentation", 0.7),
    ("template", "presentation", 0.8),
    ("screen", "presentation", 0.8),
    ("api", "api", 0.9),
    ("graphql", "api", 1.0),
    ("grpc", "api", 1.0),
    ("endpoint", "api", 0.9),
)

# Names of directories.
DIRECTORY_RULES = (
    ("controllers", "controller", 1.0),
    ("controller", "controller", 1.0),
    ("routes", "controller", 1.0),
    ("handlers", "controller", 0.9),
    ("endpoints", "controller", 0.9),
    ("services", "business", 1.0),
    ("service", "business", 1.0),
    ("core", "business", 0.8),
    ("domain", "business", 0.9),
    ("logic", "business", 0.8),
    ("use_cases", "business", 1.0),
    ("usecases", "business", 0.9),
    ("models", "data", 0.9),
    ("entities", "data", 1.0),
    ("repositories", "data", 1.0),
    ("repository", "data", 1.0),
    ("dao", "data", 1.0),
    ("dal", "data", 1.0),
    ("gateways", "data", 0.9),
    ("middleware", "middleware", 1.0),
    ("filters", "middleware", 0.8),
    ("interceptors", "middleware", 0.9),
    ("aspects", "middleware", 0.8),
    ("config", "config", 1.0),
    ("configuration", "config", 1.0),
    ("settings", "config", 0.9),
    ("env", "config", 0.5),
    ("utils", "utility", 1.0),
    ("util", "utility", 1.0),
    ("helpers", "utility", 1.0),
    ("common", "utility", 0.7),
    ("shared", "utility", 0.7),
    ("lib", "utility", 0.6),
    ("support", "utility", 0.7),
    ("infrastructure", "infrastructure", 1.0),
    ("infra", "infrastructure", 1.0),
    ("adapters", "infrastructure", 1.0),
    ("adapter", "infrastructure", 1.0),
    ("external", "infrastructure", 0.8),
    ("clients", "infrastructure", 0.8),
    ("providers", "infrastructure", 0.8),
    ("migrations", "migration", 1.0),
    ("migrate", "migration", 1.0),
    ("alembic", "migration", 0.8),
    ("tests", "testing", 1.0),
    ("test", "testing", 1.0),
    ("spec", "testing", 1.0),
    ("specs", "testing", 1.0),
    ("__tests__", "testing", 1.0),
    ("views", "presentation", 1.0),
    ("templates", "presentation", 1.0),
    ("ui", "presentation", 0.9),
    ("components", "presentation", 0.9),
    ("pages", "presentation", 0.8),
    ("screens", "presentation", 0.8),
    ("api", "api", 0.9),
    ("rest", "api", 0.8),
    ("graphql", "api", 1.0),
    ("grpc", "api", 1.0),
)

# Layers each pattern asks for.
PATTERNS = (
    ("mvc", "controller", "presentation", "data"),
    ("layered", "presentation", "business", "data"),
    ("clean", "business", "infrastructure", "api"),
    ("hexagonal", "business", "infrastructure", "api"),
    ("repository", "data"),
    ("service_oriented", "api", "business"),
)

# A framework's pattern, its layers, and its confidence where that is fixed.
FRAMEWORK_PATTERNS = (
    ("django", None, "data", "controller"),
    ("rails", 0.9, "controller", "data", "presentation"),
    ("spring_boot", 0.85, "controller", "business"),
    ("nestjs", None, "controller", "business"),
    ("express", None, "controller", "data", "presentation"),
    ("fastapi", None, "controller", "data", "middleware"),
    ("next.js", None, "presentation", "api", "config"),
    ("laravel", None, "controller", "data", "presentation", "migration"),
    ("actix_web", None, "controller", "data", "middleware"),
    ("axum", None, "controller", "data", "middleware", "config"),
)

# Directory segments that hint at a framework when the manifest names none.
FRAMEWORK_SEGMENTS = (
    ("django", "settings", 0.5),
    ("django", "wsgi", 0.3),
    ("laravel", "app/http", 0.5),
    ("nestjs", "module", 0.5),
    ("express", "routes", 0.4),
    ("express", "controllers", 0.4),
    ("express", "middleware", 0.3),
    ("fastapi", "routers", 0.5),
    ("fastapi", "schemas", 0.4),
    ("next.js", "pages", 0.4),
    ("actix_web", "handlers", 0.4),
    ("axum", "handlers", 0.4),
)

# File names that hint at a framework.
FRAMEWORK_FILES = (
    ("django", "manage.py", 0.8),
    ("rails", "gemfile", 0.5),
    ("laravel", "artisan", 0.6),
    ("next.js", "next.config.js", 0.7),
    ("next.js", "next.config.ts", 0.7),
    ("nestjs", "nest-cli.json", 0.7),
    ("spring_boot", "pom.xml", 0.6),
    ("spring_boot", "build.gradle", 0.6),
)

# Other names of layers.
ALIASES = (
    ("models", "data"),
    ("model", "data"),
    ("service", "business"),
    ("services", "business"),
    ("view", "presentation"),
    ("views", "presentation"),
    ("route", "controller"),
    ("routes", "controller"),
    ("handler", "controller"),
    ("handlers", "controller"),
    ("repo", "data"),
    ("repos", "data"),
)

# Directions in which layers are expected to depend.
EXPECTED_FLOWS = (("controller", "business"), ("business", "data"), ("api", "business"), ("middleware", "controller"), ("presentation", "business"))

# Files and folders that frameworks have, by framework: name or stem, layer, weight.
FRAMEWORK_FILE_RULES = (
    ("django", "models.py", "data", 1.0),
    ("django", "admin.py", "presentation", 0.7),
    ("django", "views.py", "presentation", 1.0),
    ("django", "urls.py", "controller", 1.0),
    ("django", "serializers.py", "data", 1.0),
    ("django", "forms.py", "presentation", 0.8),
    ("django", "apps.py", "config", 0.8),
    ("flask", "models.py", "data", 1.0),
    ("flask", "views.py", "presentation", 0.8),
    ("flask", "routes.py", "controller", 1.0),
    ("flask", "forms.py", "presentation", 0.7),
    ("rails", "application_controller.rb", "controller", 1.0),
    ("rails", "application_record.rb", "data", 1.0),
    ("rails", "routes.rb", "controller", 1.0),
    ("express", "routes", "controller", 1.0),
    ("express", "controllers", "controller", 1.0),
    ("express", "middleware", "middleware", 1.0),
    ("express", "models", "data", 1.0),
    ("express", "views", "presentation", 0.9),
    ("express", "app.js", "controller", 0.6),
    ("express", "server.js", "controller", 0.6),
    ("express", "router", "controller", 0.9),
    ("fastapi", "routers", "controller", 1.0),
    ("fastapi", "schemas", "data", 1.0),
    ("fastapi", "models", "data", 0.9),
    ("fastapi", "dependencies", "middleware", 0.8),
    ("fastapi", "main.py", "controller", 0.6),
    ("fastapi", "app.py", "controller", 0.6),
    ("next.js", "page", "presentation", 1.0),
    ("next.js", "layout", "presentation", 0.9),
    ("next.js", "loading", "presentation", 0.7),
    ("next.js", "error", "presentation", 0.7),
    ("next.js", "not-found", "presentation", 0.6),
    ("next.js", "route", "api", 1.0),
    ("next.js", "api", "api", 0.9),
    ("next.js", "components", "presentation", 0.8),
    ("laravel", "Controller", "controller", 1.0),
    ("laravel", "Request", "controller", 0.7),
    ("laravel", "Resource", "controller", 0.7),
    ("laravel", "Model", "data", 1.0),
    ("laravel", "Migration", "migration", 1.0),
    ("laravel", "Seeder", "data", 0.6),
    ("laravel", "Factory", "infrastructure", 0.6),
    ("laravel", "routes", "controller", 0.9),
    ("laravel", "web.php", "controller", 1.0),
    ("laravel", "api.php", "api", 1.0),
    ("actix_web", "handlers", "controller", 1.0),
    ("actix_web", "handler", "controller", 0.8),
    ("actix_web", "routes", "controller", 0.9),
    ("actix_web", "models", "data", 0.8),
    ("actix_web", "middleware", "middleware", 1.0),
    ("actix_web", "main.rs", "controller", 0.5),
    ("axum", "handlers", "controller", 1.0),
    ("axum", "handler", "controller", 0.8),
    ("axum", "routes", "controller", 0.9),
    ("axum", "models", "data", 0.8),
    ("axum", "state", "config", 0.7),
    ("axum", "middleware", "middleware", 1.0),
    ("axum", "main.rs", "controller", 0.5),
)

# Files that make a folder an application of Django, and Rails' own folders with their layers.
DJANGO_APP_FILES = ("models.py", "views.py", "urls.py", "admin.py")
RAILS_FOLDERS = (("app/controllers", "controller"), ("app/models", "data"), ("app/views", "presentation"))
