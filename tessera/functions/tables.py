"""Lookup tables that results depend on, in one place."""

from __future__ import annotations

#: Words that lexical search leaves out.
STOPWORDS = "the a an and or of to in for on is this that it as with by be are from at if we you return const".split()

#: Path extension to language; ".d.ts" is "other".
LANGUAGE_OF = {
    "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx", "rs": "rust", "py": "python", "pyi": "python",
    "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "go": "go", "java": "java", "php": "php", "rb": "ruby",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "swift": "swift",
}

#: Dependencies that give a package its role, in order of priority.
ROLE_DEPENDENCIES = {
    "mobile": "react-native expo @expo/ @react-navigation/ @react-native nativewind".split(),
    "frontend": "next nuxt vite @vitejs/ vue svelte @sveltejs/ @angular/ react-dom react-router-dom gatsby @remix-run/ astro leptos yew dioxus sycamore".split(),
    "backend": (
        "express fastify elysia hono koa @nestjs/ @hapi/ drizzle-orm drizzle-kit prisma @prisma/ mongoose typeorm sequelize knex pg "
        "postgres mysql mysql2 @aws-sdk/ firebase-admin ioredis bullmq kafkajs @trpc/server apollo-server graphql-yoga "
        "axum actix rocket warp tonic sqlx diesel sea-orm sea_orm "
        "django flask fastapi starlette sqlalchemy alembic celery aiohttp tornado psycopg2 asyncpg"
    ).split(),
}

#: Parts of "name dir" that give a role, in order of priority.
ROLE_NAMES = {
    "mobile": ["mobile", "expo", "react-native", "native", "/app"],
    "backend": ["backend", "server", "/api", "worker", "lambda", "functions"],
    "frontend": ["frontend", "web", "client", "www", "dashboard", "admin", "site"],
    "docs": ["docs", "documentation"],
    "shared": ["shared", "common", "core", "types", "schema", "lib", "util", "packages/"],
}

#: Directory names that give the files below them a role.
SEGMENT_ROLES = {
    "backend": (
        "server backend api apis routes route controllers controller services service db database migrations migration prisma drizzle "
        "worker workers jobs queue lambda functions handlers middleware serializers repositories repository usecases dao entities"
    ).split(),
    "frontend": "web www frontend client pages dashboard admin site".split(),
    "mobile": "mobile native screens navigation".split(),
    "docs": "docs documentation".split(),
    "shared": "shared common core types util utils helpers lib libs dto constants".split(),
}

#: Query words that speak for a layer.
LAYER_TERMS = {
    "backend": (
        "route router controller service endpoint api handler transaction atomic schema migration drizzle sql query db database table "
        "column index constraint unique presign bucket storage upload cdn webhook cron queue worker middleware auth token credit billing "
        "payment deduct balance ledger invoice server axum actix tokio sqlx diesel tonic grpc django flask fastapi sqlalchemy alembic "
        "celery pydantic orm repository usecase serializer gorm"
    ).split(),
    "frontend": "page css dom browser spa ssr hydrate vite webpack router route fetch form".split(),
    "mobile": (
        "screen layout component tap press gesture scroll navigation navigator navigate view render style stylesheet expo native tab modal "
        "sheet drawer safearea keyboard animation animated flatlist touchable pressable"
    ).split(),
    "shared": "type interface enum constant shared util helper dto".split(),
    "docs": "readme documentation guide changelog".split(),
}

#: File stems that name a module, not a kind of file.
ENTRY_STEMS = ["index", "mod", "lib", "main"]

#: Extensions that a relative import may leave out, in order.
SCRIPT_EXTENSIONS = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
