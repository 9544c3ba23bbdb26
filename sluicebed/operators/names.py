"""What providers and kinds are called."""

#: Providers by name.
PROVIDERS = {
    "github": "GitHub", "gitlab": "GitLab", "slack": "Slack", "aws": "AWS", "gcp": "Google Cloud", "azure": "Azure", "sops": "sops", "anthropic": "Anthropic", "openai": "OpenAI", "grafana": "Grafana", "pagerduty": "PagerDuty", "npm": "npm",
    "kubernetes": "Kubernetes", "privatekey": "private key", "oci": "Registry",
}
#: Kinds by what they are.
KINDS = {
    "github-pat": "personal access token (classic)", "github-fine-grained-pat": "fine-grained personal access token", "github-oauth": "OAuth access token", "github-user-to-server": "GitHub App user-to-server token", "github-refresh": "GitHub App refresh token", "github-server-to-server": "GitHub App installation token",
    "gitlab-pat": "personal access token (routable tokens carry a CRC32 checksum)", "gitlab-deploy-token": "deploy token", "gitlab-runner-token": "runner authentication token", "gitlab-ci-job-token": "CI job token", "gitlab-pipeline-trigger-token": "pipeline trigger token", "gitlab-feed-token": "feed token",
    "gitlab-incoming-mail-token": "incoming mail token", "gitlab-agent-token": "agent for Kubernetes token", "gitlab-oauth-app-secret": "OAuth application secret", "gitlab-feature-flag-client-token": "feature flag client (Unleash instance) token", "gitlab-scim-token": "SCIM token",
    "slack-bot-token": "bot token", "slack-user-token": "user token", "slack-app-token": "app-level token", "slack-refresh-token": "refresh token", "slack-config-token": "configuration token", "slack-webhook": "incoming webhook",
    "aws-access-key": "access key", "aws-temporary-access-key": "temporary access key (STS)",
    "gcp-service-account-key": "service account key (JSON)", "gcp-oauth-user-credentials": "application default credentials of a user (authorized_user JSON)", "gcp-oauth-access-token": "OAuth access token", "gcp-oauth-refresh-token": "OAuth refresh token", "gcp-api-key": "API key",
    "azure-client-secret": "Entra ID application (service principal) client secret", "azure-storage-account-key": "storage account access key", "azure-sas-token": "shared access signature",
    "age-identity": "age identity",
    "anthropic-api-key": "API key (the fixed AA suffix is padding, not a checksum, but it removes random look-alikes)", "anthropic-admin-api-key": "Admin API key (same AA suffix)", "anthropic-oauth-token": "OAuth access token (Claude Code sign-in)", "anthropic-oauth-refresh-token": "OAuth refresh token (Claude Code sign-in)",
    "openai-project-key": "project key", "openai-service-account-key": "service account key", "openai-admin-key": "admin key", "openai-legacy-key": "legacy user key",
    "grafana-service-account-token": "service account token", "grafana-cloud-access-policy-token": "Grafana Cloud access policy token", "grafana-legacy-api-key": "API key (legacy, pre-service-account)",
    "pagerduty-api-key": "REST API key (general access or user)", "pagerduty-routing-key": "routing key (Events API integration key)",
    "npm-access-token": "access token", "npm-legacy-token": "legacy token (UUID, from an .npmrc _authToken)",
    "kubernetes-client-certificate": "client certificate", "kubernetes-service-account-token": "service account token", "kubernetes-token": "bearer token", "kubernetes-basic-auth": "basic auth login", "kubernetes-secret-manifest": "Secret manifest with plaintext values",
    "ssh-private-key": "SSH private key", "tls-private-key": "TLS or generic PEM private key", "cosign-private-key": "cosign signing key (encrypted)",
    "docker-hub-pat": "Docker Hub personal access token", "docker-hub-oat": "Docker Hub organization access token", "quay-robot-token": "Quay robot account token", "quay-oauth-token": "Quay OAuth access token", "docker-hub-login": "Docker Hub login", "quay-login": "Quay login", "acr-login": "Azure Container Registry login",
    "ghcr-login": "GitHub Container Registry login", "gcr-login": "Google Artifact Registry login", "ecr-login": "Amazon ECR login",
}


def called(provider: str, kind: str) -> str:
    """A kind with its provider's name; the kind itself where it has no name."""
    return f"{PROVIDERS[provider]} {KINDS[kind]}" if provider in PROVIDERS and kind in KINDS else kind
